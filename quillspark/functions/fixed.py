"""Texts, label lists and constants that results have to equal exactly."""

from __future__ import annotations

# ---- fixed values: label lists, id = position ---------------------------------------
LABELS = {
    "yahoo": [
        "Society & Culture", "Science & Mathematics", "Health", "Education & Reference",
        "Computers & Internet", "Sports", "Business & Finance", "Entertainment & Music",
        "Family & Relationships", "Politics & Government",
    ],
    "sst2": ["negative", "positive"],
    "imdb": ["negative", "positive"],
    "ots": ["potentially unfair", "clearly unfair", "clearly fair"],
    "huff": ["WELLNESS", "POLITICS", "TRAVEL", "ENTERTAINMENT", "STYLE & BEAUTY"],
    "atis": [
        "flight", "flight_time", "airfare", "aircraft", "ground_service", "airport", "airline",
        "distance", "abbreviation", "ground_fare", "quantity", "city", "flight_no", "capacity",
        "flight+airfare", "meal", "restriction",
    ],
    "massive": [
        "alarm_set", "audio_volume_mute", "iot_hue_lightchange", "iot_hue_lightoff",
        "iot_hue_lighton", "iot_hue_lightdim", "iot_cleaning", "calendar_query", "play_music",
        "general_quirky", "general_greet", "datetime_query", "datetime_convert",
        "takeaway_query", "alarm_remove", "alarm_query", "news_query", "music_likeness",
        "music_query", "iot_hue_lightup", "takeaway_order", "weather_query", "music_settings",
        "audio_volume_down", "general_joke", "music_dislikeness", "audio_volume_other",
        "iot_coffee", "audio_volume_up", "iot_wemo_on", "iot_wemo_off", "qa_stock",
        "play_radio", "social_post", "recommendation_locations", "cooking_recipe",
        "qa_factoid", "recommendation_events", "calendar_set", "play_audiobook",
        "play_podcasts", "social_query", "transport_query", "email_sendemail",
        "transport_ticket", "recommendation_movies", "lists_query", "play_game",
        "email_query", "transport_traffic", "cooking_query", "qa_definition",
        "calendar_remove", "lists_remove", "email_querycontact", "lists_createoradd",
        "email_addcontact", "transport_taxi", "qa_maths", "qa_currency",
    ],
    "nli": ["Entailment", "Contradiction", "Neutral"],
    "qqp": ["No paraphrase", "Paraphrase"],
    "subj": ["Subjective", "Objective"],
}
DEFAULT_LABELS = ["Negative", "Positive"]

# ---- fixed values: entity glosses by tag type (the same for B- and I-) ---------------
GLOSSES = {
    "conll2003": {
        "MISC": "miscellaneous", "PER": "person", "LOC": "location", "ORG": "organization",
    },
    "multiconer": {
        "PER": "person", "LOC": "location", "GRP": "group", "CW": "creative work",
        "CORP": "corporation", "PROD": "product",
    },
    "onto": {
        "DATE": "date", "MONEY": "money", "WORK_OF_ART": "work of art", "CARDINAL": "cardinal",
        "ORG": "organization", "PERSON": "person", "GPE": "geo-political entity",
        "NORP": "affiliation", "PERCENT": "percent", "ORDINAL": "ordinal", "TIME": "time",
        "LOC": "location", "PRODUCT": "product", "FAC": "building", "EVENT": "event",
        "QUANTITY": "quantity", "LANGUAGE": "language", "LAW": "law",
    },
    "bc2gm": {"GENE": "Gene"},
    "ebmnlp": {"O": "Outcome", "I": "Intervention", "P": "Participant"},
}

# ---- fixed values: topic wording ------------------------------------------------------
TOPIC_SENTENCES = {
    "ots": "The document's terms of service should be {label}",
    "yahoo": "The document should be on the topic of {label}",
    "huff": "The document should be on the topic of {label}",
    "atis": "The document should be on the topic of {label}",
    "massive": "The document should be on the topic of {label}",
}
# (topic keyword, topic) per dataset
TOPIC_PAIRS_SENTENCES = {
    "ots": ("topic", "online terms of service"),
    "yahoo": ("topic", "categories"),
    "sst2": ("sentiment", "sentiment"),
}
TOPIC_PAIRS_DOCUMENT = {
    "ots": ("topic", "online terms of service"),
    "yahoo": ("topic", "categories"),
    "sst2": ("topic", "movie review"),
    "imdb": ("topic", "movie review"),
}

# ---- fixed values: prompt wording -----------------------------------------------------
ABSTRACT_REQUEST = "Write an abstract of the following {unit} in a few words:\n"
NO_CONCEPT = " should not include the abstract concept "
CONCEPT_REQUEST = """I will provide you with some constraints followed by pairs of sentences and their respective keywords. Please do the following:
1. Find one high level concept common across these sentences considering their respective keywords.
2. The high level concept should contain at most 2 words.
3. The high level concept should be enclosed in #.
4. Output only the high level concept in the above format and nothing else.
"""

BRIEF_ABS = "Write a brief document with a single sentence or multiple sentences corresponding to the following abstract description: $abs$."
BRIEF_SOLO = "Write a brief document with a single sentence or multiple sentences with the following constraints:"
DOCUMENT_ALSO = "Additionally, the document should have the following contraints:"
SENTENCE_ALSO = "Additionally, the sentence should have the following contraints:"

KEYWORDS_BOTH = "The {unit} should have the following keywords: {inc_kws}, but should not have the following keywords : {exc_kws}."
KEYWORDS_IN = "The {unit} should have the following keywords: {inc_kws}."
TOPIC_LINE = "{topic}. Here are also some examples: {exemplars}."
TOPIC_PAIR_LINE = "The document should be on the {topic_kw}: {topic}. Here are also some examples: {exemplars}."
TOPIC_PAIR_SENTENCES_LINE = "The sentences should be on the {topic_kw}: {topic}. Here are some examples: {exemplars}."
TOPIC_START_LINE = "The {start} should be on the topic: {topic}"
EXAMPLES_LINE = "Here are also some examples: {exemplars}."
ENTITIES_LINE = "{ner_labels}."
POS_LINE = "The {unit} should have a part-of-speech sequence similar to: {pos_seq}."
LENGTH_LINE = "The {unit} should have a length of {min_words}-{max_words} words."
SIMILAR_LINE = "The {start} should {label} semantically similar to the sentence: {sent2}"
QA_SOLO = "Write a brief document with multiple sentences corresponding to the following constraints:"
QUESTION_LINE = "The document should anwer the question: {question}."

# ---- fixed values: chat wrapper ---------------------------------------------------------
CHAT_SYSTEM = (
    "You are an assistant that only returns what is requested for and nothing else."
    "If you are questioned to return a document, only return the document and not a single extra word."
    "You will be asked to generate a document following some constraints, and you will only output documents that follow all constraints."
)
CHAT_PREFIX = "<<SYS>>\n{system}\n<</SYS>>\n\n"
CHAT_OPEN = "[INST] "
CHAT_CLOSE = " [/INST]"

# ---- fixed values: numbers ---------------------------------------------------------------
PROPOSAL_WEIGHT = 0.003
REPORT_SEEDS = [7, 9, 13, 17, 19]
SPECIAL_TOKENS = ["[PAD]", "[CLS]", "[SEP]", "[UNK]"]
DATASET_NAMES = {
    "hans": "HANS", "SNLI_cad": "SNLI CAD", "breaking_nli": "Break", "SNLI_short": "SNLI", "QQP16": "QQP",
}
