"""Values that have to equal those of the data and of earlier published results.

Fixed values: patterns, file names, code tables and lookup tables.  They are
data, not logic; everything else in the package is derived from them.
"""

# Identifier patterns.  DOI and the dump patterns use classes that
# have to be Unicode-aware, which Java only does under the (?U) flag.
DOI_PATTERN = r"(?U)(10\.\d{4,}\/[^,\s;]*)"
PMID_PATTERN = r"0*([1-9][0-9]{1,8})"
PMC_MARK = "PMC"
ISBN_PATTERN = r"(ISBN[-]*(1[03])*[ ]*(: ){0,1})*(([0-9Xx][- ]*){13}|([0-9Xx][- ]*){10})"
ISBN_SEPARATORS = r"[- ]"
META_OMID_PATTERN = r"(?U)(omid:[^\s]+)"
META_DOI_PATTERN = r'(?U)((?:doi):[^\s\"]+)'
META_PMID_PATTERN = r'(?U)((?:pmid):[^\s\"]+)'
META_ISBN_PATTERN = r'(?U)((?:isbn):[^\s\"]+)'
SCHEME_PATTERN = r"^(doi|pmid|isbn)"
YEAR_PATTERN = r"(?U)(\d{4})"

# Identifier schemes in order of preference.
SCHEMES = ("doi", "pmid", "isbn")

# Which item keeps an identifier that several items share, per
# scheme, as type code -> priority (lower wins, other codes come last).
TYPE_PRIORITY = {
    "doi": {35: 1, 50: 2, 41: 3, 57: 4},
    "pmid": {35: 1},
    "isbn": {49: 1, 35: 2},
}

# Preferred (global type, item type code) pairs.
TYPE_PREFERENCE = (
    ("journal article", 35, 0),
    ("book chapter", 41, 1),
    ("book chapter", 42, 2),
)

# Local type label -> global type.
TYPE_MAPPING = (
    ("7.05 Banche dati", "dataset"),
    ("7.15 Test psicologici", "dataset"),
    ("1.04 Replica / breve intervento (e simili)", "other"),
    ("2.04 Breve introduzione", "other"),
    ("2.02 Prefazione", "other"),
    ("2.03 Postfazione", "other"),
    ("4.02 Riassunto (Abstract)", "other"),
    ("4.03 Poster", "other"),
    ("1.02 Nota a sentenza", "other"),
    ("2.06 Commento giuridico", "other"),
    ("3.04 Pubblicazione di fonti inedite", "other"),
    ("2.05 Voce in dizionario o enciclopedia", "reference entry"),
    ("1.05 Scheda bibliografica", "reference entry"),
    ("4.01 Contributo in Atti di convegno", "proceedings article"),
    ("7.13 Rapporto tecnico", "report"),
    ("2.01 Capitolo / saggio in libro", "book chapter"),
    ("2.08 Recensione in volume", "book chapter"),
    ("5.02 Contributo in volume (Traduzione)", "book chapter"),
    ("3.01 Monografia / trattato scientifico in forma di libro", "book"),
    ("5.01 Libro (Traduzione)", "book"),
    ("3.02 Curatela", "book"),
    ("3.03 Edizione critica", "book"),
    ("1.01 Articolo in rivista", "journal article"),
    ("5.03 Contributo in rivista (Traduzione)", "journal article"),
    ("1.06 Abstract in rivista", "journal article"),
    ("1.03 Recensione in rivista", "journal article"),
    ("3.07 Bibliografia", "reference book"),
    (None, ""),
)

# Labels given to blank or missing categories in reports.
NO_TYPE_LABEL = "no type"
MISSING_TYPE_LABEL = "No type"
UNSPECIFIED_LABEL = "not specified"

# File names of the repository tables.
MASTER_FILE = "ODS_L1_IR_ITEM_MASTER_ALL.csv"
IDENTIFIER_FILE = "ODS_L1_IR_ITEM_IDENTIFIER.csv"
DESCRIPTION_FILE = "ODS_L1_IR_ITEM_DESCRIPTION.csv"
PUBLISHER_FILE = "ODS_L1_IR_ITEM_PUBLISHER.csv"
LANGUAGE_FILE = "ODS_L1_IR_ITEM_LANGUAGE.csv"
RELATION_FILE = "ODS_L1_IR_ITEM_RELATION.csv"

# Repository releases whose files lie in a subfolder of the archive.
RELEASE_SUBFOLDERS = {"2025-05-30": "POSTPROCESS-iris-data-2025-05-27"}

# Prefix of global entity addresses, and of the ids made from them.
ENTITY_ADDRESS = "https://w3id.org/oc/meta/"
OMID_PREFIX = "omid:"

# Thresholds of the reports.
LAST_VALID_YEAR = 2025
FIRST_CHART_YEAR = 1950
ITEM_CHART_YEAR_BELOW = 2030
MATCH_SCORE_ABOVE = 85
MIN_TITLE_WORDS = 3
