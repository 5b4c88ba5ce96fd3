"""Fixed values that results depend on: file layouts, code tables, patterns and defaults."""

from __future__ import annotations

# -- fixed values: column orders of the raw files (no header) -------------------------
MENTION_COLUMNS = [
    "GlobalEventID", "EventTimeDate", "MentionTimeDate", "MentionType", "MentionSourceName", "MentionIdentifier", "SentenceID",
    "Actor1CharOffset", "Actor2CharOffset", "ActionCharOffset", "InRawText", "Confidence", "MentionDocLen", "MentionDocTone",
    "MentionDocTranslationInfo", "Extras",
]
_ACTOR = ["Code", "Name", "CountryCode", "KnownGroupCode", "EthnicCode", "Religion1Code", "Religion2Code", "Type1Code", "Type2Code", "Type3Code"]
_GEO = ["Type", "FullName", "CountryCode", "ADM1Code", "ADM2Code", "Lat", "Long", "FeatureID"]
EVENT_COLUMNS = [
    "GlobalEventID", "Day", "MonthYear", "Year", "FractionDate",
    *[f"Actor1{x}" for x in _ACTOR], *[f"Actor2{x}" for x in _ACTOR],
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    *[f"Actor1Geo_{x}" for x in _GEO], *[f"Actor2Geo_{x}" for x in _GEO], *[f"ActionGeo_{x}" for x in _GEO],
    "DATEADDED", "SOURCEURL",
]
GKG_COLUMNS = [
    "GKGRecordID", "Date", "SourceCollectionIdentifier", "SourceCommonName", "DocumentIdentifier", "Counts", "V2Counts", "Themes", "V2Themes",
    "Locations", "V2Locations", "Persons", "V2Persons", "Organizations", "V2Organizations", "V2Tone", "Dates", "GCAM", "SharingImage",
    "RelatedImages", "SocialImageEmbeds", "SocialVideoEmbeds", "Quotations", "AllNames", "Amounts", "TranslationInfo", "Extras",
]
MENTION_INTS = [
    "GlobalEventID", "MentionType", "SentenceID", "Actor1CharOffset", "Actor2CharOffset", "ActionCharOffset", "InRawText", "Confidence", "MentionDocLen",
]
EVENT_INTS = [
    "GlobalEventID", "Day", "MonthYear", "Year", "IsRootEvent", "QuadClass", "NumMentions", "NumSources", "NumArticles",
    "Actor1Geo_Type", "Actor2Geo_Type", "ActionGeo_Type",
]
EVENT_FLOATS = [
    "FractionDate", "GoldsteinScale", "AvgTone", "Actor1Geo_Lat", "Actor1Geo_Long", "Actor2Geo_Lat", "Actor2Geo_Long", "ActionGeo_Lat", "ActionGeo_Long",
]

# -- fixed values: query parameters that don't identify a page ------------------------
TRACKING_PARAMS = ("fbclid", "gclid", "ref", "source", "cmp", "ncid", "ito", "mc_cid", "mc_eid")

# -- fixed values: two-letter domains sold to anyone, so no sign of a country ---------
GENERIC_TWO_LETTER = ("co", "io", "me", "tv", "fm", "ai", "ly", "to", "cc", "ws", "gg", "am", "eu", "su")

# -- fixed values: country domains (ISO 3166-1) whose FIPS 10-4 code differs ----------
ISO2_TO_FIPS = {
    "AD": "AN", "AG": "AC", "AI": "AV", "AQ": "AY", "AS": "AQ", "AT": "AU", "AU": "AS", "AW": "AA", "AZ": "AJ", "BA": "BK", "BD": "BG", "BF": "UV",
    "BG": "BU", "BH": "BA", "BI": "BY", "BJ": "BN", "BL": "TB", "BM": "BD", "BN": "BX", "BO": "BL", "BS": "BF", "BW": "BC", "BY": "BO", "BZ": "BH",
    "CC": "CK", "CD": "CG", "CF": "CT", "CG": "CF", "CH": "SZ", "CI": "IV", "CK": "CW", "CL": "CI", "CN": "CH", "CR": "CS", "CX": "KT", "CZ": "EZ",
    "DE": "GM", "DK": "DA", "DM": "DO", "DO": "DR", "DZ": "AG", "EE": "EN", "ES": "SP", "GA": "GB", "GB": "UK", "GD": "GJ", "GE": "GG", "GF": "FG",
    "GG": "GK", "GM": "GA", "GN": "GV", "GQ": "EK", "GS": "SX", "GU": "GQ", "GW": "PU", "HN": "HO", "HT": "HA", "IE": "EI", "IL": "IS", "IQ": "IZ",
    "IS": "IC", "JP": "JA", "KH": "CB", "KI": "KR", "KM": "CN", "KN": "SC", "KP": "KN", "KR": "KS", "KW": "KU", "KY": "CJ", "LB": "LE", "LC": "ST",
    "LI": "LS", "LK": "CE", "LR": "LI", "LS": "LT", "LT": "LH", "LV": "LG", "MA": "MO", "MC": "MN", "ME": "MJ", "MG": "MA", "MH": "RM", "MM": "BM",
    "MN": "MG", "MO": "MC", "MP": "CQ", "MQ": "MB", "MS": "MH", "MU": "MP", "MW": "MI", "NA": "WA", "NE": "NG", "NG": "NI", "NI": "NU", "NU": "NE",
    "OM": "MU", "PA": "PM", "PF": "FP", "PG": "PP", "PH": "RP", "PM": "SB", "PN": "PC", "PR": "RQ", "PS": "WE", "PT": "PO", "PW": "PS", "PY": "PA",
    "RS": "RI", "RU": "RS", "SB": "BP", "SC": "SE", "SD": "SU", "SE": "SW", "SG": "SN", "SK": "LO", "SN": "SG", "SR": "NS", "SS": "OD", "ST": "TP",
    "SV": "ES", "SZ": "WZ", "TC": "TK", "TD": "CD", "TG": "TO", "TJ": "TI", "TK": "TL", "TL": "TT", "TM": "TX", "TN": "TS", "TO": "TN", "TR": "TU",
    "TT": "TD", "UA": "UP", "VA": "VT", "VG": "VI", "VI": "VQ", "VN": "VM", "VU": "NH", "YE": "YM", "YT": "MF", "ZA": "SF", "ZM": "ZA", "ZW": "ZI",
}

# -- fixed values: source language codes and country domains by name ------------------
LANGUAGE_NAMES = {
    "ara": "Arabic", "ben": "Bengali", "bul": "Bulgarian", "cat": "Catalan", "ces": "Czech", "dan": "Danish", "deu": "German", "ell": "Greek",
    "eng": "English", "est": "Estonian", "fas": "Persian", "fin": "Finnish", "fra": "French", "heb": "Hebrew", "hin": "Hindi", "hrv": "Croatian",
    "hun": "Hungarian", "ind": "Indonesian", "isl": "Icelandic", "ita": "Italian", "jpn": "Japanese", "kor": "Korean", "lav": "Latvian",
    "lit": "Lithuanian", "msa": "Malay", "nld": "Dutch", "nor": "Norwegian", "pol": "Polish", "por": "Portuguese", "ron": "Romanian",
    "rus": "Russian", "slk": "Slovak", "slv": "Slovenian", "som": "Somali", "spa": "Spanish", "sqi": "Albanian", "srp": "Serbian",
    "swe": "Swedish", "tha": "Thai", "tur": "Turkish", "ukr": "Ukrainian", "urd": "Urdu", "vie": "Vietnamese", "zho": "Chinese",
}
TLD_COUNTRIES = {
    "ae": "United Arab Emirates", "af": "Afghanistan", "ar": "Argentina", "at": "Austria", "au": "Australia", "bd": "Bangladesh", "be": "Belgium",
    "bg": "Bulgaria", "br": "Brazil", "ca": "Canada", "ch": "Switzerland", "cl": "Chile", "cn": "China", "co": "Colombia", "cy": "Cyprus",
    "cz": "Czech Republic", "de": "Germany", "dk": "Denmark", "eg": "Egypt", "es": "Spain", "fi": "Finland", "fr": "France", "gh": "Ghana",
    "gr": "Greece", "hk": "Hong Kong", "hr": "Croatia", "hu": "Hungary", "id": "Indonesia", "ie": "Ireland", "il": "Israel", "in": "India",
    "iq": "Iraq", "ir": "Iran", "is": "Iceland", "it": "Italy", "jp": "Japan", "ke": "Kenya", "kr": "South Korea", "lk": "Sri Lanka",
    "lt": "Lithuania", "lv": "Latvia", "ma": "Morocco", "mx": "Mexico", "my": "Malaysia", "ng": "Nigeria", "nl": "Netherlands", "no": "Norway",
    "nz": "New Zealand", "pe": "Peru", "ph": "Philippines", "pk": "Pakistan", "pl": "Poland", "pt": "Portugal", "qa": "Qatar", "ro": "Romania",
    "rs": "Serbia", "ru": "Russia", "sa": "Saudi Arabia", "se": "Sweden", "sg": "Singapore", "si": "Slovenia", "sk": "Slovakia", "th": "Thailand",
    "tr": "Turkey", "tw": "Taiwan", "tz": "Tanzania", "ua": "Ukraine", "ug": "Uganda", "uk": "United Kingdom", "uy": "Uruguay",
    "ve": "Venezuela", "vn": "Vietnam", "za": "South Africa", "zm": "Zambia", "zw": "Zimbabwe",
}

# -- fixed values: CAMEO codes --------------------------------------------------------
QUAD_CLASSES = {1: "Verbal Cooperation", 2: "Material Cooperation", 3: "Verbal Conflict", 4: "Material Conflict"}
EVENT_ROOT_CODES = {
    "01": "Make Public Statement", "02": "Appeal", "03": "Express Intent To Cooperate", "04": "Consult", "05": "Engage In Diplomatic Cooperation",
    "06": "Engage In Material Cooperation", "07": "Provide Aid", "08": "Yield", "09": "Investigate", "10": "Demand", "11": "Disapprove",
    "12": "Reject", "13": "Threaten", "14": "Protest", "15": "Exhibit Force Posture", "16": "Reduce Relations", "17": "Coerce", "18": "Assault",
    "19": "Fight", "20": "Use Unconventional Mass Violence",
}
CAMEO_ROOT_TYPES = {"14": "protest", "17": "coercion_repression", "18": "armed_conflict", "19": "armed_conflict", "20": "armed_conflict"}

# -- fixed values: themes that make a type of event -----------------------------------
THEME_TYPES = [
    ("natural_disaster", r"^NATURAL_DISASTER"),
    ("fire", r"^DISASTER_FIRE|WILDFIRE"),
    ("accident", r"^MANMADE_DISASTER"),
    ("armed_conflict", r"^ARMEDCONFLICT|^WB_2432_FRAGILITY_CONFLICT"),
    ("terrorism", r"^TERROR|^SUICIDE_ATTACK|^EXTREMISM"),
    ("protest", r"^PROTEST|^GENERAL_STRIKE"),
    ("election", r"^ELECTION"),
    ("legal_judicial", r"^TRIAL|^ARREST|^SOC_JUDICIAL|^LEGALIZE"),
    ("crime", r"^CRIME|^KIDNAP|^DRUG_TRADE|^SECURITY_SERVICES"),
    ("death", r"^TAX_FNCACT_VICTIM|^CRISISLEX_T03_DEAD"),
    ("health", r"^HEALTH_|^MEDICAL|^EPIDEMIC|^PANDEMIC|^TAX_DISEASE"),
    ("economy_business", r"^ECON_|^BUS_"),
    ("environment_climate", r"^ENV_|^CLIMATE"),
    ("politics_government", r"^LEGISLATION|^EPU_POLICY|^USPEC_POLICY|^GENERAL_GOVERNMENT"),
    ("religion_culture", r"^RELIGION|^TAX_RELIGION"),
    ("sports", r"^SPORT|^TAX_SPORTS"),
]

# -- fixed values: words that label nothing -------------------------------------------
LABEL_STOP = (
    "news", "article", "story", "world", "local", "national", "politics", "latest", "says", "new", "html", "id", "content", "nation", "us", "uk",
)

# -- fixed values: words of URL paths that carry no topic -----------------------------
STOPWORDS = (
    "the", "and", "for", "that", "with", "from", "this", "are", "was", "has", "have", "after", "into", "over", "amid", "says", "news", "world",
    "article", "articles", "story", "stories", "html", "htm", "com", "www", "index", "amp", "live", "a", "an", "of", "to", "in", "on", "at", "as",
    "is", "it", "be", "its", "us", "uk",
)

# -- fixed values: known stories of the evaluation week, by URL slug ------------------
STORY_PATTERNS = {
    "crash_grounding": r"ethiopian|boeing|737",
    "christchurch": r"christchurch|mosque",
    "idai": r"idai|cyclone|mozambique",
    "brexit": r"brexit",
}
BENCHMARK_PATTERNS = {
    "idai_strict": r"(^|[^a-z])idai([^a-z]|$)",
    "border_veto": r"veto.*(border|emergency|national)|(border|emergency).*veto",
    "college_admissions": r"loughlin|huffman|admissions?-(scandal|scam|bribery|cheating)",
    "manafort": r"manafort",
    "pell": r"(^|[^a-z])pell([^a-z]|$)",
    "smollett": r"smollett",
    "bomb_cyclone": r"bomb-?cyclone",
    "pelosi_impeachment": r"pelosi.*impeach|impeach.*pelosi",
    "venezuela_blackout": r"venezuela.*(blackout|power|outage|electricity)",
    "r_kelly": r"r-kelly|rkelly",
    "gmail_outage": r"(gmail|google).*(outage|down|disruption)",
}

# -- fixed values: scoring channels (weight, floor alone, minimum as evidence) --------
CHANNEL_WEIGHTS = {"title": 2.0, "event": 1.5, "url": 1.0, "entity": 0.5}
CHANNEL_FLOORS = {"title": 0.55, "event": 0.8, "url": 0.8, "entity": 0.9}
EVIDENCE_MINIMA = {"title": 0.4, "event": 0.05, "url": 0.2, "entity": 0.15}

# -- fixed values: bins of event size by effective reports (low, high exclusive) ------
MAGNITUDE_BINS = (
    ("5-19 effective reports", 5, 20),
    ("20-99 effective reports", 20, 100),
    ("100-499 effective reports", 100, 500),
    ("500+ effective reports", 500, None),
)

# -- fixed values: output columns of the response tables ---------------------------
OBSERVATION_COLUMNS = [
    "level", "event_id", "family_id", "title", "event_start", "event_end", "start_truncated", "event_types", "event_documents",
    "event_effective_reports", "resolution_model", "origin_country", "origin_share", "destination_country", "is_domestic", "origin_onset",
    "destination_onset", "world_onset", "response_hours_origin", "response_hours_world", "self_response_hours", "response_reference",
    "response_hours", "has_documents", "covered", "suppressed", "censor_hours", "raw_documents", "unique_domains", "effective_reports",
    "attention_ratio",
]
RECORD_COLUMNS = [
    "level", "event_id", "family_id", "title", "event_start", "event_types", "event_effective_reports", "origin_country", "destination_country",
    "origin_onset", "destination_onset", "world_onset", "response_hours", "response_reference", "covered", "suppressed", "has_documents",
    "censor_hours", "raw_documents", "effective_reports", "attention_ratio",
]

# -- fixed values: fields of an event in answers (name, column) ------------------------
EVENT_FIELDS = {
    "globaleventid": "GlobalEventID", "day": "Day", "dateadded": "dateadded", "actor1": "Actor1Name", "actor2": "Actor2Name", "actor1country": "Actor1CountryCode",
    "actor2country": "Actor2CountryCode", "eventcode": "EventCode", "rootcode": "EventRootCode", "rootlabel": "root_label", "quadclass": "QuadClass", "quadlabel": "quadlabel",
    "goldstein": "GoldsteinScale", "avgtone": "AvgTone", "nummentions": "NumMentions", "numsources": "NumSources", "numarticles": "NumArticles",
    "location": "ActionGeo_FullName", "countrycode": "ActionGeo_CountryCode", "lat": "ActionGeo_Lat", "lon": "ActionGeo_Long", "sourceurl": "sourceurl",
}
