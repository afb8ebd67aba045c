"""Fixed values.

Everything in this module is a value that has to be exactly so for results to be right: label names,
aliases, confidence grades, prompt wording, word lists, thresholds. No logic lives here.
"""

# --- tasks, data sets and their labels (fixed values) ---------------------------------------------

TASK_LABELS = {
    "sentiment": ["positive", "negative"],
    "toxicity": ["toxic", "non-toxic"],
    "crisis_classification": ["crisis", "not_crisis"],
    "fact_verification": ["supports", "refutes", "not_enough_info"],
}

DATASETS = {
    "imdb": {
        "name": "IMDb Sentiment",
        "task": "sentiment",
        "classes": ["negative", "positive"],
        "split_ratios": {"train": 0.7, "dev": 0.15, "test": 0.15},
    },
    "jigsaw": {
        "name": "Jigsaw Toxicity",
        "task": "toxicity",
        "classes": ["non-toxic", "toxic"],
        "split_ratios": {"train": 0.7, "dev": 0.15, "test": 0.15},
    },
    "crisisbench_humanitarian": {
        "name": "CrisisBench (Humanitarian)",
        "task": "crisis_humanitarian",
        "classes": [
            "infrastructure_and_utilities_damage",
            "not_humanitarian",
            "injured_or_dead_people",
            "sympathy_and_support",
            "donation_and_volunteering",
            "response_efforts",
            "caution_and_advice",
            "requests_or_needs",
            "affected_individual",
            "displaced_and_evacuations",
            "missing_and_found_people",
        ],
        "split_ratios": {"train": 0.7, "dev": 0.15, "test": 0.15},
    },
    "crisisbench_informativeness": {
        "name": "CrisisBench (Informativeness)",
        "task": "crisis_informativeness",
        "classes": ["informative", "not_informative"],
        "split_ratios": {"train": 0.7, "dev": 0.15, "test": 0.15},
    },
    "fever": {
        "name": "FEVER Fact Verification",
        "task": "fact_verification",
        "classes": ["REFUTES", "NOT ENOUGH INFO", "SUPPORTS"],
        "split_ratios": None,
    },
}

LABEL_NAMES = {
    "imdb": {0: "negative", 1: "positive"},
    "jigsaw": {0: "non-toxic", 1: "toxic"},
    "fever": {0: "refutes", 1: "NOT ENOUGH INFO", 2: "supports"},
}

LABEL_CODES = {
    "imdb": {"negative": 0, "positive": 1},
    "jigsaw": {"non-toxic": 0, "toxic": 1},
    "fever": {"refutes": 0, "not_enough_info": 1, "supports": 2},
}

CLAIM_LABELS = {"REFUTES": 0, "NOT ENOUGH INFO": 1, "SUPPORTS": 2}

LABEL_ALIASES = {
    "nei": "not_enough_info",
    "non_toxic": "non-toxic",
    "nontoxic": "non-toxic",
    "not_toxic": "non-toxic",
}

DISPLAY_LABELS = {"not_enough_info": "NOT ENOUGH INFO"}

TOXICITY_TEXT_COLUMNS = ["text", "comment_text", "comment"]
CRISIS_TEXT_COLUMNS = ["text", "tweet_text"]
REVIEW_TEXT_COLUMNS = ["text", "review"]
LABEL_COLUMNS = ["label", "labels", "class_label"]
TOXICITY_COLUMNS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

# --- verbal confidence (fixed values) -------------------------------------------------------------

CONFIDENCE_VALUES = {"low": 0.3, "medium": 0.6, "high": 0.9}

# --- prompt wording (fixed values) ----------------------------------------------------------------

TASK_INSTRUCTIONS = {
    "sentiment": "Task: Classify the sentiment of text as positive or negative.",
    "toxicity": "Task: Classify whether text is toxic or non-toxic.",
    "crisis_classification": "Task: Classify whether text reports a crisis or emergency situation.",
    "fact_verification": "Task: Verify whether a claim is supported, refuted, or has not enough information.",
}

RULES_WITH_RATIONALE = """
Output format:
<json>{"label": "...", "confidence": "low/medium/high", "rationale": "10-200 chars from text"}</json>

Requirements:
- "confidence" must be: low, medium, or high
- "rationale" must cite evidence from input text (10-200 characters)
- If uncertain, use "confidence": "low"
- Output ONLY the JSON, nothing else"""

RULES_WITHOUT_RATIONALE = """
Output format:
<json>{"label": "...", "confidence": "low/medium/high"}</json>

Requirements:
- "confidence" must be: low, medium, or high
- If uncertain, use "confidence": "low"
- Output ONLY the JSON, nothing else"""

# --- word lists (fixed values) --------------------------------------------------------------------

NEGATION_WORDS = ["no", "not", "never", "nothing", "none", "nobody", "nowhere", "neither", "nor"]
NEGATION_CONTRACTIONS = ["can't", "cannot", "won't", "wouldn't", "shouldn't", "couldn't"]
NEGATION_PREFIXES = ["dis", "un", "in", "im", "ir", "non", "anti"]
HEDGE_MODALS = ["might", "may", "could", "would", "should", "possibly", "perhaps", "maybe"]
HEDGE_DEGREES = ["somewhat", "rather", "quite", "fairly", "relatively"]
HEDGE_PHRASES = ["i think", "i believe", "i guess", "i suppose", "it seems"]
HEDGE_LIKELIHOODS = ["probably", "likely", "unlikely", "apparently", "supposedly"]
INTENSIFIERS_STRONG = ["very", "extremely", "highly", "completely", "totally", "absolutely", "definitely"]
INTENSIFIERS_MILD = ["so", "such", "really", "quite", "rather", "pretty", "fairly"]
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "wonderful", "fantastic"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "horrible", "disgusting", "hate"]

# --- thresholds and sizes (fixed values) ----------------------------------------------------------

SEED = 42
HASH_PREFIX = 16
PREVIEW_LENGTH = 100
MIN_RATIONALE = 10
LOW_CONFIDENCE = 0.6
AGREEMENT_THRESHOLD = 0.7
ENTROPY_THRESHOLD = 0.8
DIFFICULTY_THRESHOLD = 0.5
DIFFICULTY_WEIGHTS = {"agreement": 0.4, "entropy": 0.3, "disagreement": 0.3}
TRUST_THRESHOLD = 0.5
MAX_PROPORTION_GAP = 0.01
AUDIT_RATE = 0.05
TRUNCATE_TOKENS = 512
CALIBRATION_BINS = 15
BINARY_BINS = 10
PROB_FLOOR = 1e-12
F1_EPSILON = 1e-8
APPROVED = "APPROVED for LLM annotation"
NEEDS_REVIEW = "REVIEW REQUIRED"

TRUST_FEATURES = [
    "llm_confidence_numeric",
    "supervised_disagreement",
    "probability_entropy",
    "max_probability",
    "text_negation_density",
    "text_hedge_density",
    "text_sentiment_score",
    "text_readability_score",
]

# Characters that count as white space in text (the Unicode set plus the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as regular-expression ranges.
WHITESPACE_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
