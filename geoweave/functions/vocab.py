"""Lists, maps, limits and messages that results depend on.

Each is given by the data and services the results are held against; none is a matter of design.
"""

from __future__ import annotations

# --- fixed values: provinces and territories -------------------------------------------------

PROVINCE_BY_NUMBER = {
    "10": "NL", "11": "PE", "12": "NS", "13": "NB", "24": "QC", "35": "ON", "46": "MB",
    "47": "SK", "48": "AB", "59": "BC", "60": "YT", "61": "NT", "62": "NU",
}

# Names are looked up after accents are folded, so accented spellings need no entry.
PROVINCE_BY_NAME = {
    "NL": "NL", "NEWFOUNDLAND": "NL",
    "PE": "PE", "PEI": "PE", "PRINCE EDWARD ISLAND": "PE",
    "NS": "NS", "NOVA SCOTIA": "NS",
    "NB": "NB", "NEW BRUNSWICK": "NB",
    "QC": "QC", "QUE": "QC", "QUEBEC": "QC",
    "ON": "ON", "ONT": "ON", "ONTARIO": "ON",
    "MB": "MB", "MANITOBA": "MB",
    "SK": "SK", "SASKATCHEWAN": "SK",
    "AB": "AB", "ALBERTA": "AB",
    "BC": "BC", "BRITISH COLUMBIA": "BC",
    "YT": "YT", "YUKON": "YT",
    "NT": "NT", "NORTHWEST TERRITORIES": "NT",
    "NU": "NU", "NUNAVUT": "NU",
}

PROVINCE_DISPLAY_NAME = {
    "NL": "Newfoundland", "PE": "Prince Edward Island", "NS": "Nova Scotia",
    "NB": "New Brunswick", "QC": "Quebec", "ON": "Ontario", "MB": "Manitoba",
    "SK": "Saskatchewan", "AB": "Alberta", "BC": "British Columbia", "YT": "Yukon",
    "NT": "Northwest Territories", "NU": "Nunavut",
}

# --- fixed values: street types and directions ------------------------------------------------

# Types that change to a canonical form.
STREET_TYPE_CANONICAL = {
    "ST": "ST", "STREET": "ST",
    "AVE": "AVE", "AV": "AVE", "AVENUE": "AVE",
    "RD": "RD", "ROAD": "RD",
    "BLVD": "BLVD", "BOULEVARD": "BLVD",
    "CRES": "CRES", "CRESCENT": "CRES",
    "DR": "DR", "DRIVE": "DR",
    "CRT": "CRT", "COURT": "CRT",
    "PL": "PL", "PLACE": "PL",
    "PKY": "PKY", "PARKWAY": "PKY",
    "HWY": "HWY", "HIGHWAY": "HWY",
    "RUE": "RUE",
    "CH": "CH", "CHEMIN": "CH",
}

# Types stored as they are. They are listed so that a street tail recognises them.
STREET_TYPE_VERBATIM = """
LANE WAY CIR TRAIL LINE PVT TERR SQ GATE SIDERD ISLAND CR
LN GDNS RIDGE GROVE MEWS CLOSE WALK BAY PATH HTS CT COMMON
HILL RUN ROW WOOD VIA GLEN HOLLOW PK TLINE CHASE GARDENS
HY MANOR PROM CIRCT GREEN CROSS PT LI VILLGE HEIGHTS LOOP
BEACH RTE CONCESSION CONC PASS COVE STREETLOUTH WY BEND FOREST
LANDNG CROSSING PARK VOIE RISE MALL VIEW QUAY BRNE VISTA
MEADOW END CERCLE MONTEE SHORE AVENUELOUTH DOWNS GLADE GS MOUNT
MILLWAY HT LANDING FARM OUTLOOK COUR PORT TSSE PKWY LKOUT
COTE HEATH GD KNOLL CHART KEY WALKWAY RLE ACRES CROIS DELL
VALE ALLEY RANG CORNERS HEIGHT LINK GV WATERWAY HARBOUR COURS
LAKEWAY PINES GATEWAY FIELD GALLERY WHARF CTR CROFT TRACE PLAZA
FRONT TRNABT MARSH DALE BYPASS ABBEY WYND ORCH LEA GT ESTATES
ROUND HALL SRD TL ME CURVE PY BYWAY TOWERS TOP CAPE WW
WLK PARADE SIDELINE PTH ISLE GREENWAY
""".split()

STREET_DIRECTION = {
    "N": "N", "S": "S", "E": "E", "W": "W",
    "NE": "NE", "NW": "NW", "SE": "SE", "SW": "SW",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}

# Words that stop the "Ave" completion of an address without a street type.
COMPLETION_STOP_WORDS = (
    "ST STREET AVE AV AVENUE RD ROAD BLVD BOULEVARD DR DRIVE CRES CRESCENT CRT COURT PL PLACE "
    "PKY PARKWAY HWY HIGHWAY RUE CH CHEMIN WAY LANE LN TRAIL TL CIR CIRCLE"
).split()

# Street types tried, in this order, when a query names none.
DEFAULT_STREET_TYPES = ["", "AVE", "ST", "RD", "DR", "BLVD", "CRES"]

# --- fixed values: city spellings -------------------------------------------------------------

ADMIN_PREFIXES = [
    "CITY OF", "TOWN OF", "TOWNSHIP OF", "COUNTY OF", "VILLAGE OF",
    "REGIONAL MUNICIPALITY OF", "FORMER",
]

CITY_ALIASES = {
    "TORONTO|ON": [
        "FORMER TORONTO", "SCARBOROUGH", "NORTH YORK", "ETOBICOKE", "YORK", "EAST YORK",
    ],
    "QUEBEC|QC": ["QUEBEC CITY"],
}

# --- fixed values: address file headers -------------------------------------------------------

ADDRESS_HEADERS = {
    "lat": ["Latitude", "latitude"],
    "lon": ["Longitude", "longitude"],
    "province": ["Province or Territory Unique Identifier", "Province", "pruid"],
    "city": ["Processed City", "city_pcs", "City", "city"],
    "civic_number": ["Civic Number", "street_no"],
    "street_name": ["Standardized Street Name", "str_name_pcs", "Street Name", "str_name"],
    "street_type": ["Standardized Street Type", "str_type_pcs", "Street Type", "str_type"],
    "street_direction": [
        "Standardized Street Direction", "str_dir_pcs", "Street Direction", "str_dir",
    ],
    "unit": ["Unit", "unit"],
    "postal_code": ["Postal Code", "postal_code"],
    "full_address": ["Full Address", "full_addr"],
}

# --- fixed values: boundary files -------------------------------------------------------------

BOUNDARY_NAME_FIELDS = [
    "ENGLISH_NAME", "ENGLISH_NA", "NAME_EN", "FED_NAME", "ED_NAMEE", "ED_NAME", "NM_CEP",
    "DIST_NAME", "DISTRICT", "DISTRICT_N", "DISTRICT_NAME", "ED", "ED_LABEL", "NAME",
]
DISTRICT_DISPLAY_FIELDS = [
    "ENGLISH_NAME", "ENGLISH_NA", "NAME_EN", "FED_NAME", "ED_NAMEE", "ED_NAME", "NM_CEP",
]
BOUNDARY_ID_FIELDS = ["FED_NUM", "RIDING_NUM", "ID"]

# code, dataset, name, year, path, aliases, status
DATASETS = [
    ("federal", "federalridings-2024", "Federal", 2024, "/api/federal", [], "live"),
    ("on", "ontarioridings-2022", "Ontario", 2022, "/api/on", ["ON", "ONT", "ONTARIO"], "live"),
    ("qc", "quebecridings-2025", "Quebec", 2025, "/api/qc", ["QC", "QUE", "QUEBEC"], "live"),
    ("bc", "bcridings-2022", "British Columbia", 2022, "/api/bc",
     ["BC", "B.C.", "BRITISH COLUMBIA"], "live"),
    ("ab", "abridings-2022", "Alberta", 2022, "/api/ab", ["AB", "ALBERTA"], "live"),
    ("ns", "nsridings-2022", "Nova Scotia", 2022, "/api/ns", ["NS", "NOVA SCOTIA"], "live"),
    ("nb", "nbridings-2022", "New Brunswick", 2022, "/api/nb", ["NB", "NEW BRUNSWICK"], "live"),
    ("mb", "mbridings-2022", "Manitoba", 2022, "/api/mb", ["MB", "MANITOBA"], "live"),
    ("sk", "skridings-2022", "Saskatchewan", 2022, "/api/sk", ["SK", "SASKATCHEWAN"], "live"),
    ("nl", "nlridings-2022", "Newfoundland and Labrador", 2022, "/api/nl",
     ["NL", "NEWFOUNDLAND", "NEWFOUNDLAND AND LABRADOR", "LABRADOR"], "live"),
    ("pe", "peridings-2022", "Prince Edward Island", 2022, "/api/pe",
     ["PE", "PEI", "PRINCE EDWARD ISLAND"], "live"),
    ("nt", "ntridings-2022", "Northwest Territories", 2022, "/api/nt",
     ["NT", "NWT", "NORTHWEST TERRITORIES"], "live"),
    ("nu", "nuridings-2022", "Nunavut", 2022, "/api/nu", ["NU", "NUNAVUT"], "live"),
    ("yt", "ytridings-2022", "Yukon", 2022, "/api/yt", ["YT", "YUKON", "YUKON TERRITORY"], "live"),
]
FEDERAL_DATASET = "federalridings-2024"
FEDERAL_PATHS = ["/api", "/api/federal", "/api/combined"]

# --- fixed values: geocoding ------------------------------------------------------------------

CONFIDENCE = {
    "exact": 1.0,
    "postal_centroid": 0.85,
    "street_interpolated": 0.75,
    "city_centroid": 0.45,
    "nearest_neighbor": 0.7,
}
MIN_CONFIDENCE = 0.6
MAX_REVERSE_METERS = 25000.0
MAX_POSTAL_HINT_METERS = 5000.0
EARTH_RADIUS_METERS = 6371000.0
NEAREST_HALF_WIDTHS = [0.0025, 0.01, 0.05, 0.25]

# --- fixed values: street search --------------------------------------------------------------

SEARCH_LIMIT = 7
SEARCH_MIN_LENGTH = 3
SEARCH_WINDOW = 50
SEARCH_MAX_LEAVES = 3
SEARCH_WEIGHTS = {
    "prefix": 0.4, "bm25": 0.25, "popularity": 0.2, "proximity": 0.1, "civic": 0.05,
}
BM25_K1 = 1.2
BM25_B = 0.75

# --- fixed values: event logs -----------------------------------------------------------------

FREE_MONTHLY_ALLOWANCE = 1000
RATE_WINDOW_SECONDS = 60
CACHE_TTL_SECONDS = 24 * 3600
RETRY_BASE_MS = 1000
RETRY_MAX_MS = 30000
MAX_ATTEMPTS = 5
DELIVERY_RETRY_BASE_MS = 5000
RETENTION_DAYS = 7
USAGE_KEEP_DAYS = 7
USAGE_KEEP_MONTHS = 3
FAILURE_ALERT_THRESHOLD = 5

DENIAL_STATUS = {
    "KEY_REQUIRED": 401, "KEY_INVALID": 401, "KEY_DISABLED": 401,
    "ORIGIN_REQUIRED": 403, "ORIGIN_NOT_ALLOWED": 403, "WRONG_KEY_KIND": 403,
    "BATCH_NOT_ENABLED": 403, "CUSTOMER_NOT_FOUND": 403,
    "DAILY_LIMIT_EXCEEDED": 429,
}

# --- fixed values: messages -------------------------------------------------------------------

MSG_COORD_PAIR = "Both lat and lon must be provided together"
MSG_LAT_RANGE = "Latitude must be between -90 and 90 (inclusive)"
MSG_LON_RANGE = "Longitude must be between -180 and 180 (inclusive)"
MSG_COORD_FINITE = "Coordinates must be finite numbers"
MSG_POSTAL = "Postal code format is invalid or too long"
MSG_RETURN = "Unknown return field: {}. Supported: municipality"
MSG_INCLUDE_PROVINCE = "include_province must be true or false"
MSG_GEOCODE_METHOD = "Invalid geocode_method. Allowed: auto, postal_centroid"
MSG_NO_LOCATION = "At least one location parameter must be provided"
MSG_BATCH_QUERY = "query must include lat/lon, postal, or address"

# --- derived from the values above ------------------------------------------------------------

STREET_TYPE_TOKENS = sorted(set(STREET_TYPE_CANONICAL) | set(STREET_TYPE_VERBATIM))
STREET_TYPE_VALUES = sorted(set(STREET_TYPE_CANONICAL.values()) | set(STREET_TYPE_VERBATIM))
STREET_DIRECTION_VALUES = sorted(set(STREET_DIRECTION.values()))
