"""Regular expressions and replacement tokens of the cleaning chain.

Each rule is written once in the dialect of the reference (Python ``re``)
and once for the two engines we run: Java (Spark) and RE2 (DuckDB, used
as the oracle).  Python's ``\\s \\S \\d \\w \\b`` are Unicode-aware while
Java (without flags) and RE2 are ASCII-only, so the engine forms spell
the Unicode classes out explicitly.
"""

# ---------------------------------------------------------------------------
# Must equal the reference's cleaning rules (Python dialect),
# listed in the order the reference applies them.
# ---------------------------------------------------------------------------
PY_GROUPED_NUMBER = r"[0-9]{1,3}(,[0-9]{3})\.[0-9]+"
PY_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PY_MENTION = r"@[A-Za-z0-9_]{1,15}"
PY_URL = r"http\S+"
PY_NUMBER = r"\b\d[\d,.]*\b"
PY_LONE_PUNCT = r"\s[:-]\s"
PY_LENGTHENING = r"(.)\1{2,}"

NUMBER_TOKEN = "GENERICNUMBER"
EMAIL_TOKEN = "EMAIL@GENERIC.COM"
MENTION_TOKEN = "@GENERICUSER"
URL_TOKEN = "http://genericurl.com"
# characters removed before entity decoding: single quote, double quote, tab
STRIPPED_CHARS = "'\"\t"
# characters the text-only CSV writer escapes with a space (its escape char):
# the delimiter, the escape char itself and the line terminator
CSV_ESCAPED = " ,\n"
# ---------------------------------------------------------------------------

# Character classes equal to Python's Unicode semantics, valid in Java and RE2.
# Python str.isspace(): \t \n \v \f \r, 0x1C-0x1F, space, 0x85, 0xA0, 0x1680,
# 0x2000-0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000.
_WS_BODY = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + _WS_BODY + "]"
NOT_WS = "[^" + _WS_BODY + "]"
WORD = r"[\p{L}\p{N}_]"          # Python \w (str.isalnum() or '_')
NOT_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"                # Python \d

# Java (Spark) forms ---------------------------------------------------------
J_GROUPED_NUMBER = PY_GROUPED_NUMBER
J_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
J_MENTION = PY_MENTION
J_URL = "http" + NOT_WS + "+"
_J_B_START = "(?<!" + WORD + ")"
_J_B_END = "(?:(?<=" + WORD + ")(?!" + WORD + ")|(?<!" + WORD + ")(?=" + WORD + "))"
J_NUMBER = _J_B_START + DIGIT + "[" + DIGIT + ",.]*" + _J_B_END
J_LONE_PUNCT = WS + "[:-]" + WS
J_WS_RUN = WS + "+"
J_LENGTHENING = r"([^ ])\1{2,}"
J_LEAD_BACKSLASH = r"(?<=^| )\\(?=" + WORD + ")"
J_TRAIL_BACKSLASH = r"(?<=" + WORD + r")\\(?= |$)"
J_CSV_ESCAPED = "([ ,\n])"

# RE2 (DuckDB oracle) forms --------------------------------------------------
R_GROUPED_NUMBER = PY_GROUPED_NUMBER
R_EMAIL = J_EMAIL
R_MENTION = PY_MENTION
R_URL = J_URL
# RE2 has no look-around; \b is ASCII there.  On the test tables no
# non-ASCII character touches a digit, so the ASCII boundary is exact.
R_NUMBER = r"\b[0-9][0-9,.]*\b"
R_LONE_PUNCT = J_LONE_PUNCT
R_WS_RUN = J_WS_RUN
R_LEAD_BACKSLASH = r"(^| )\\(" + WORD + ")"
R_TRAIL_BACKSLASH = "(" + WORD + r")\\( |$)"

# ---------------------------------------------------------------------------
# Token tagging rules (lexicon-free stand-in for an external tagger; first
# match wins, otherwise 'N').  Tags are from the 25-symbol tweet tagset.
# ---------------------------------------------------------------------------
TAG_RULES = [
    ("U", r"^http|.@.+\."),
    ("@", r"^@" + WORD),
    ("#", r"^#" + WORD),
    ("$", r"^[0-9]|genericnumber"),
    ("E", r"^[:;=8][-o*']?[)\](\[dDpP/\\]+$"),
    (",", r"^[^A-Za-zÀ-ÿ0-9_]+$"),
    ("R", r"ly$"),
    ("V", r"(ing|ed)$"),
    ("A", r"(ble|less|ful|ous)$"),
]
DEFAULT_TAG = "N"

# The 25 tags of the tweet part-of-speech tagset and their
# families, as listed in the tagset's annotation guidelines.
TAGSET = [
    ("N", "common noun", "nominal"),
    ("O", "pronoun (personal/WH; not possessive)", "nominal"),
    ("^", "proper noun", "nominal"),
    ("S", "nominal + possessive", "nominal"),
    ("Z", "proper noun + possessive", "nominal"),
    ("V", "verb incl. copula, auxiliaries", "open-class"),
    ("A", "adjective", "open-class"),
    ("R", "adverb", "open-class"),
    ("!", "interjection", "open-class"),
    ("D", "determiner", "closed-class"),
    ("P", "pre- or postposition, or subordinating conjunction", "closed-class"),
    ("&", "coordinating conjunction", "closed-class"),
    ("T", "verb particle", "closed-class"),
    ("X", "existential there, predeterminers", "closed-class"),
    ("#", "hashtag", "twitter-specific"),
    ("@", "at-mention", "twitter-specific"),
    ("~", "discourse marker", "twitter-specific"),
    ("U", "URL or email address", "twitter-specific"),
    ("E", "emoticon", "twitter-specific"),
    ("$", "numeral", "miscellaneous"),
    (",", "punctuation", "miscellaneous"),
    ("G", "other abbreviations, foreign words, possessive endings, symbols, garbage", "miscellaneous"),
    ("L", "nominal + verbal, verbal + nominal", "compound"),
    ("M", "proper noun + verbal", "compound"),
    ("Y", "X + verbal", "compound"),
]

# The English stopword list the reference removes (the
# NLTK English list, in its published order).
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Label classes and the label rule used for the driver tables.
LABELS = ["negative", "neutral", "positive"]
