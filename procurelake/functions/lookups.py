"""Dictionary lookups as map literals, so that no join or shuffle is planned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procurelake.functions.text import strip

# Country codes and variants. Names not listed stay as they are in lower case.
COUNTRY_NAMES = {
    "PT": "portugal", "ES": "spain", "FR": "france", "DE": "germany", "IT": "italy",
    "UK": "uk", "GB": "uk", "NL": "netherlands", "BE": "belgium", "AT": "austria",
    "SE": "sweden", "NO": "norway", "FI": "finland", "DK": "denmark", "PL": "poland",
    "CZ": "czech_republic", "HR": "croatia", "GR": "greece", "IE": "ireland",
    "CH": "switzerland", "XK": "kosovo", "AL": "albania", "RS": "serbia",
    "MK": "north_macedonia", "SI": "slovenia", "SK": "slovakia", "HU": "hungary",
    "RO": "romania", "BG": "bulgaria", "BGr": "bulgaria", "LT": "lithuania",
    "LTu": "lithuania", "LV": "latvia", "LVa": "latvia", "EE": "estonia", "ESt": "estonia",
    "CY": "cyprus", "CYp": "cyprus", "MT": "malta", "LU": "luxembourg", "IS": "iceland",
    "ISl": "iceland", "MD": "moldova", "MDa": "moldova", "SEN": "senegal",
    "BES": "caribbean_netherlands", "united_kingdom": "uk",
}

# Three-letter country codes of nested notices.
ALPHA3_COUNTRIES = {
    "DEU": "germany", "FRA": "france", "SWE": "sweden", "CZE": "czech_republic",
    "CHE": "switzerland", "BEL": "belgium", "POL": "poland", "NOR": "norway",
    "AUT": "austria", "HRV": "croatia", "PRT": "portugal", "ESP": "spain", "ITA": "italy",
    "NLD": "netherlands", "DNK": "denmark", "FIN": "finland", "GRC": "greece",
    "HUN": "hungary", "IRL": "ireland", "LUX": "luxembourg", "ROU": "romania",
    "SVK": "slovakia", "SVN": "slovenia", "GBR": "united_kingdom", "ALB": "albania",
    "BIH": "bosnia_herzegovina", "XKX": "kosovo", "MKD": "north_macedonia",
    "MNE": "montenegro", "SRB": "serbia",
}

# Categories in Portuguese, Albanian, Croatian and English; the case matters.
CATEGORY_NAMES = {
    "Empreitada de obras públicas": "works",
    "Aquisição de serviços": "services",
    "Aquisição de bens móveis": "goods",
    "Locação de bens móveis": "goods",
    "Concessão de serviços públicos": "services",
    "Concessão de obras públicas": "works",
    "Punë": "works",
    "Shërbime": "services",
    "Mallra": "goods",
    "Radovi": "works",
    "Usluge": "services",
    "Roba": "goods",
    "works": "works",
    "services": "services",
    "goods": "goods",
    "supplies": "goods",
}

# Words in buyer names, a country name, and a source tag that point to Portugal.
HOME_COUNTRY = "portugal"
HOME_SOURCE_TAG = "BASE.gov.pt"
HOME_BUYER_WORDS = (
    "município", "câmara", "junta", "governo", "estado-maior",
    "ministério", "secretaria", "fundação", "autoridade",
)
UNKNOWN_COUNTRY = "unknown"


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def standard_category(c: Column) -> Column:
    """Exact-case lookup; what is not listed becomes ''."""
    return F.coalesce(_map(CATEGORY_NAMES)[c], F.lit(""))


def standard_country(c: Column) -> Column:
    """Listed code or variant to its name, anything else in lower case; NULL is 'none'."""
    bare = strip(F.coalesce(c.cast("string"), F.lit("None")))
    return F.coalesce(_map(COUNTRY_NAMES)[bare], F.lower(bare))


def notice_country(code: Column, location: Column, source: Column, buyer: Column) -> Column:
    """Country of a nested notice, by the first rule that answers:

    its code, its place of execution, its source tag, words in its buyer's name.
    """
    places = F.transform(F.split(F.lower(location), ","), strip)
    at_home = (F.get(places, F.lit(0)) == HOME_COUNTRY) | (F.element_at(places, -1) == HOME_COUNTRY)
    return F.coalesce(
        F.when(code != "", F.coalesce(_map(ALPHA3_COUNTRIES)[code], F.lower(code))),
        F.when(at_home, HOME_COUNTRY),
        F.when(source.contains(HOME_SOURCE_TAG), HOME_COUNTRY),
        F.when(F.lower(buyer).rlike("|".join(HOME_BUYER_WORDS)), HOME_COUNTRY),
        F.lit(UNKNOWN_COUNTRY),
    )
