"""Values that results depend on: word lists, code maps, grids and cut-off dates."""

# Fixed values. Seed of every split.
SEED = 42

# Fixed values. Language filter: share bound and number of articles that must be exceeded.
SHARE_THRESHOLD = 0.95
MIN_ARTICLES = 25

# Fixed values. A text of the nested collection needs more words than this.
MIN_WORDS = 10

# Fixed values. Language codes of the nested collection.
LANGUAGE_NAMES = {
    "en": "English",
    "es": "Spanish",
    "pt": "Portuguese",
    "hi": "Hindi",
    "fr": "French",
    "it": "Italian",
}

# Fixed values. Row order of the result tables.
REPORT_LANGUAGES = [
    "English", "Russian", "German", "French", "Spanish", "Georgian", "Czech",
    "Polish", "Italian", "Lithuanian", "Romanian", "Slovak", "Serbian", "Finnish",
]

# Fixed values. Parameter grids of the bag-of-words models, and the number of folds.
ALPHAS = [0.01, 0.1, 1.0, 10.0]
COSTS = [0.001, 0.1, 1.0, 5.0, 10.0]
FOLDS = 10

# Fixed values. Sequence length of the encoder.
MAX_LENGTH = 512

# Fixed values. Cut-off dates of the temporal splits, day-month-year.
EVENTS = [("Covid-19", "01-10-2019"), ("Invasion of Ukraine", "24-02-2022")]

# Fixed values. Keywords per held-out topic, compared after lower-casing.
HOLDOUT_TOPICS = {
    "covid-19": [
        "biological weapons",
        "chemical weapons/attack",
        "conspiracy theory",
        "coronavirus",
        "laboratory",
        "vaccination",
        "virus/bacteria threat",
    ],
    "west": [
        "eu/nato enlargement",
        "europe",
        "european union",
        "international law",
        "nato",
        "us presence in europe",
        "united nations",
        "west",
    ],
    "russia": [
        "alexei navalny",
        "anti-russian",
        "destabilising russia",
        "diplomacy with russia",
        "encircling russia",
        "russian world",
        "russophobia",
        "ussr",
    ],
    "ukraine": [
        "crimea",
        "donbas",
        "eastern ukraine",
        "invasion of ukraine",
        "ukrainian statehood",
        "war crimes",
        "war in ukraine",
    ],
}

# Fixed values. Keywords per topic of the quarterly tables and the name shown for each.
TOPICS = {
    "covid-19": {
        "biological weapons": "Biological weapons",
        "chemical weapons/attack": "Chemical weapons/attack",
        "conspiracy theory": "Conspiracy theory",
        "coronavirus": "Coronavirus",
        "laboratory": "Laboratory",
        "vaccination": "Vaccination",
        "virus / bacteria threat": "Virus/bacteria threat",
        "virus/bacteria threat": "Virus/bacteria threat",
    },
    "west": {
        "eu/nato enlargement": "EU/NATO enlargement",
        "europe": "Europe",
        "european union": "European Union",
        "international law": "International law",
        "nato": "NATO",
        "us presence in europe": "US presence in Europe",
        "united nations": "United Nations",
        "west": "West",
    },
    "russia": {
        "alexei navalny": "Alexei Navalny",
        "anti-russian": "Anti-Russian",
        "destabilising russia": "Destabilising Russia",
        "diplomacy with russia": "Diplomacy with Russia",
        "encircling russia": "Encircling Russia",
        "russian world": "Russian world",
        "russophobia": "Russophobia",
        "ussr": "USSR",
    },
    "ukraine": {
        "crimea": "Crimea",
        "donbas": "Donbas",
        "eastern ukraine": "Eastern Ukraine",
        "illegal annexation": "Illegal annexation",
        "invasion of ukraine": "Invasion of Ukraine",
        "ukraine": "Ukraine",
        "ukrainian statehood": "Ukrainian statehood",
        "war crimes": "War crimes",
        "war in ukraine": "War in Ukraine",
    },
}

# Fixed values. N-grams that refer to related cases: four words, then three words.
CUE_NGRAMS = [
    "recurring pro-kremlin disinformation narrative",
    "pro-kremlin disinformation narrative about",
    "disinformation narrative about",
    "see other examples of",
    "a recurring pro-kremlin disinformation",
    "this is a recurring",
    "disinformation cases alleging that",
    "similar cases claiming that",
    "pro-kremlin disinformation narratives about",
    "recurring pro-kremlin disinformation narratives",
    "read more about the",
    "read similar cases claiming",
    "is a recurring pro-kremlin",
    "other examples of similar",
    "recurring pro-kremlin narrative about",
    "a recurring pro-kremlin narrative",
    "a recurring disinformation narrative",
    "earlier disinformation cases alleging",
    "see earlier disinformation cases",
    "disinformation narratives about",
    "recurring pro-kremlin disinformation",
    "pro-kremlin disinformation narrative",
    "a recurring pro-kremlin",
    "see other examples",
    "pro-kremlin disinformation narratives",
    "recurring pro-kremlin narrative",
    "other examples of",
    "is a recurring",
    "see similar cases",
]
