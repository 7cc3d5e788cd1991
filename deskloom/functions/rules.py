"""Rule tables: label sets, cue lists, patterns, thresholds and templates.

Everything in this module is data. Operators take these values as parameters, so
another product line can pass its own tables. Patterns are matched with ``any_case`` or
``same_case``, which make word boundaries, spaces and case folding Unicode-aware.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------------------
# They decide results and must stay as they are.
# --------------------------------------------------------------------------------------

# Closed intent taxonomy; position = label id.
TAXONOMY = (
    "ACCOUNT_ACCESS",
    "BATTERY_DRAIN",
    "BILLING_DISPUTE",
    "DEVICE_BOOT",
    "UNKNOWN",
    "UPDATE_FAILURE",
)

# Label set accepted from model-written payloads.
PAYLOAD_INTENTS = (
    "BATTERY_DRAIN",
    "DEVICE_BOOT",
    "ACCOUNT_ACCESS",
    "BILLING_DISPUTE",
    "UPDATE_FAILURE",
    "HARDWARE_DAMAGE",
    "CONNECTIVITY_ISSUE",
    "UNKNOWN",
)

OTHER = "UNKNOWN"

# Cue phrases per intent. List order breaks ties.
CUES = {
    "ACCOUNT_ACCESS": [
        "apple id", "password", "sign in", "login", "locked", "verification", "2fa",
        "two-factor", "icloud", "recover", "passcode", "security question", "disabled",
    ],
    "BATTERY_DRAIN": [
        "battery", "drain", "charge", "charger", "charging", "overheat", "dying",
        "battery health", "percentage", "drops from", "cable", "hot",
    ],
    "BILLING_DISPUTE": [
        "charged", "charge", "refund", "subscription", "itunes", "app store", "receipt",
        "billing", "payment", "bank", "invoice", "unauthorized", "cancel", "money",
    ],
    "DEVICE_BOOT": [
        "turn on", "won't turn", "black screen", "frozen", "freeze", "stuck on apple logo",
        "reboot", "restart", "boot loop", "crash", "white screen", "hard reset",
    ],
    "UPDATE_FAILURE": [
        "ios update", "update failed", "unable to verify update", "error occurred installing",
        "storage full update", "ios 11", "downloading update", "software update",
        "installing update",
    ],
    "UNKNOWN": [
        "store", "appointment", "hours", "macbook", "airpods", "trade in", "repair",
        "genius bar", "case", "color", "shipping", "delivery", "broken glass",
    ],
}

# Safety families, in the order they are tried.
LEGAL = (
    r"\b(lawyer|attorney|lawsuit|sue|suing|court|fcc|ftc|gdpr|police|crime|consumer protection)\b"
)
FRAUD = (
    r"\b(hacked|unauthorized charge|unauthorized purchase|stolen apple id|stolen card"
    r"|compromised account|sim swap)\b"
)
CHURN = (
    r"\b(3rd time|4th time|5th time|multiple times|switching to android|useless support"
    r"|never buying apple again)\b"
)
HAZARD = (
    r"\b(smoke|smoking|spark|sparks|sparking|exploded|explosion|melted|melting|burning|burned"
    r"|burns|shock|shocked|shattered|cut|bleed|bleeding)\b"
)
AMBIGUOUS = r"\b(fire|bomb|lit|dying|killing)\b"
NEGATIONS = (
    r"\b(no|not|neither|without|never|didn't|did not|wasn't|was not|isn't|is not)\s+"
    r"(smoke|spark|sparks|fire|explosion|melting|burn|shock)\b",
    r"\b(worried|afraid|thought|feared)\b.*?\b(smoke|smoking|fire|melt|melting|burn)\b.*?"
    r"\b(but|though|luckily|thankfully|just|didn't|did not)\b",
    r"\b(thankfully|luckily)\s+(no|there is no|there was no)\s+(smoke|fire|sparks)\b",
)
SLANG = (
    r"\b(is|are|was|straight|pure|so|too)\s+(fire|the bomb|lit)\b",
    r"\b(fire|bomb)\s+(update|camera|feature|phone|color|app)\b",
    r"\b(dying|killing me)\s+(laughing|rn|right now)\b",
    r"\b(battery|phone|device|iphone|ipad|it|charge)\s+(is\s+)?(dying|dies|dead)\b",
    r"\b(dying\s+(fast|quick|rapidly|in\s+\d+|within\s+\d+|soon|again|overnight))\b",
    r"\b(dumpster fire)\b",
)

# Terms that force escalation of a model-classified case.
HIGH_RISK = (
    "lawyer", "attorney", "sue", "lawsuit", "data breach", "gdpr", "fire", "smoke",
    "explosion", "injury",
)

# Promissory phrases: three named sets that differ.
PROMISSORY = {
    "engine": (
        r"\b(we will replace|we guarantee|free of charge|we will refund|we promise to fix"
        r"|100% guarantee|definitely a hardware fault)\b"
    ),
    "benchmark": (
        r"\b(we will replace|we guarantee|free of charge|we will refund|we promise to fix"
        r"|100% guarantee|definitely a hardware fault|free repair|we'll replace"
        r"|guaranteed fix|free replacement)\b"
    ),
    "judge": (
        r"\b(we (can|will|do|shall) guarantee|we will replace|we'll replace|free of charge"
        r"|we will refund|we can refund|we promise to fix|100% guarantee"
        r"|definitely a hardware fault|free repair|guaranteed fix|free replacement)\b"
    ),
}

# English stop words: Spark's default list without the entries that hold an apostrophe,
# which tokenising splits.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
    "cannot", "could", "ought", "would",
)

# Link and device vocabulary.
LINK = (
    r"(https?://\S+|twitter\.com/messages|t\.co/|apple\.com|reportaproblem\.apple\.com"
    r"|getsupport\.apple\.com)"
)
DM_WORDS = ("dm us", "direct message", "send us a dm", "move to dm", "dm")
DM_LINKS = ("twitter.com/messages", "t.co", "apple.com", "http", "getsupport")
DRAFT_DEVICES = ("iphone", "ipad", "macbook", "watch", "ios", "macos")
DEVICES = ("iphone", "ipad", "macbook", "watch", "ios")
VERSION = r"\b(ios\s*\d+|1[0-8]\.\d+)\b"
ASKS_DEVICE = ("device", "model", "which iphone", "what device")
ASKS_VERSION = ("ios", "version", "update", "os")
ASKS_DIAGNOSTIC = ("ios", "version", "model", "which device")
JUDGE_ASKS_VERSION = r"\b(ios\s*\d+|version|update|os)\b"
JUDGE_ASKS_MODEL = r"\b(model|iphone|ipad|watch|mac|which device)\b"
EMPATHY = (
    "we'd like to help", "we can help", "happy to help", "look into this", "assistance",
    "offer some assistance",
)
FILLER = ("we are truly sorry", "deeply apologize")

# Pair quality keywords.
PAIR_KEYWORDS = ("dm", "apple", "help")

# Brand constants.
BRAND_TAG = "@115858"
DM_LINK = "https://twitter.com/messages/compose"
HELP_LINK = "https://apple.co/support"
SAFE_TRIAGE = (
    "{customer_handle} We'd like to take a closer look into what's happening. "
    "Send us a DM with your exact device model, iOS version, and details so we can assist: "
    "{dm_link}"
)
CANNED_REPLY = (
    "We are sorry to hear you are having trouble. Please DM us your device details so we can help."
)
KEYWORD_REPLIES = (
    (
        ("battery", "drain"),
        "We are truly sorry to hear that your battery is draining quickly! "
        "Please try restarting your device, toggling Low Power Mode, or resetting all settings. "
        "If issues persist, visit any Apple Store and our Genius Bar will inspect and replace "
        "your battery for free.",
    ),
    (
        ("boot", "screen", "turn on"),
        "That sounds frustrating! Have you tried connecting your device to a computer and "
        "restoring it via iTunes? If it remains stuck on the Apple logo, please make an "
        "appointment at your nearest Apple Retail store.",
    ),
    (
        ("charge", "refund", "subscription"),
        "Hello! For billing questions, please visit reportaproblem.apple.com to review your "
        "purchases. We can guarantee a full refund if the purchase was accidental or "
        "unauthorized.",
    ),
)
KEYWORD_REPLY_ELSE = (
    "Thanks for reaching out to Apple Support! We want to make sure your Apple device works "
    "seamlessly. Please let us know more about what is happening, or give our phone support "
    "hotline a call during business hours."
)

# --------------------------------------------------------------------------------------
# Thresholds, grouped so a caller can override one of them.
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SafetyRules:
    legal: str = LEGAL
    fraud: str = FRAUD
    churn: str = CHURN
    hazard: str = HAZARD
    ambiguous: str = AMBIGUOUS
    negations: tuple[str, ...] = NEGATIONS
    slang: tuple[str, ...] = SLANG


@dataclass(frozen=True)
class Zones:
    """Similarity thresholds of the confidence zones."""

    high: float = 0.25
    moderate: float = 0.12


DENSE_ZONES = Zones(high=0.75, moderate=0.55)


@dataclass(frozen=True)
class Limits:
    reply_chars: int = 280
    ideal_chars: int = 240
    min_query_chars: int = 15
    min_reply_chars: int = 20
    min_candidate_chars: int = 25
    max_candidate_chars: int = 250
    min_request_chars: int = 2
    max_request_chars: int = 500
    max_batch: int = 256
    pool_size: int = 350
    quota: int = 120
    accept_at: float = 0.80
    queue_at: float = 0.60


LIMITS = Limits()


@dataclass(frozen=True)
class Brand:
    """Who answers, and where a customer is sent."""

    author: str = "applesupport"
    tag: str = BRAND_TAG
    dm_link: str = DM_LINK
    help_link: str = HELP_LINK
    keywords: tuple[str, ...] = field(default=PAIR_KEYWORDS)
    #: Wording for a generator; decides no result of this library.
    instruction: str = (
        "Write one short public answer in the brand's name. Be kind and to the point, send the customer to a "
        "private message with {dm_link}, promise no repair, refund or outcome, and stay below 240 characters. "
    )
    ask_nothing: str = "Device and system version are known; don't ask for them."
    ask_device: str = "Ask for the device model and the system version."
    judge_instruction: str = (
        "Rate the answer from 1 to 5 on each of diagnostic_probe, privacy_pivot, zero_liability and overall_score, "
        "and give a one-sentence rationale. Return one JSON object with these five fields."
    )


BRAND = Brand()


def any_case(pattern: str) -> str:
    """The pattern as a Java regex: any case, Unicode boundaries, digits and spaces, lines end at \\n only."""
    return "(?idU)" + pattern


def same_case(pattern: str) -> str:
    """The pattern as a Java regex: case kept, Unicode boundaries, digits and spaces, lines end at \\n only."""
    return "(?dU)" + pattern


def high_risk_pattern(terms: tuple[str, ...] = HIGH_RISK) -> str:
    return r"\b(" + "|".join(terms) + r")\b"
