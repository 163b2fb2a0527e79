"""What must be exactly so for the same values to be found, named and kept.

Patterns are in the syntax of ``re``; ``java`` turns one into what Spark's functions take.
"""

from __future__ import annotations

# --- entity types
EMAIL, PHONE, CASE, PARCEL, CARD = "מייל", "טלפון", "תיק", "גושחלקה", "אשראי"
PERSON_ID, COMPANY_ID, NEUTRAL_ID, CLIENT = "תז", "חפ", "מזהה", "לקוח"

# --- identifiers
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(?<!\d)(?:\+972[\-\s]?|0)(?:[2-9]\d?)[\-\s]?\d{3}[\-\s]?\d{4}(?!\d)"
CASE_PATTERN = r'(?:פש"?ר|חדל"?פ|הוצל"?פ|ת"?א|ה"?פ|תיק)\s*:?\s*(\d{4,9})'
PARCEL_PATTERN = r"גוש\s*\d+\s*חלקה\s*\d+"
CARD_PATTERN = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,4})(?!\d)"
LABELED_ID_PATTERN = (
    r'(?P<label>ח[.\"״\']?\s*פ|ת[.\"״\']?\s*ז|ע[.\"״\']?\s*מ|עוסק\s+מורשה|מספר\s+חברה|ח\.?\s*ל\.?\s*צ)'
    r"\s*[:#.\-]?\s*(?P<num>\d[\d.\-/ ]{7,13}\d)"
)
SEPARATED_ID_PATTERN = r"(?<![\d.\-/])\d[\d.\-/]{7,12}\d(?![\d.\-/])"
BARE_ID_PATTERN = r"(?<!\d)\d{9}(?!\d)"
ID_DIGITS, CARD_DIGITS = 9, (13, 19)

# --- names
PROCLITICS = "לבומהשכ"
WORD_PATTERN = r"[^\s.,;:!?()\[\]{}\"'/\\־\-]+"

# --- placeholders
OPEN, CLOSE = "⟦", "⟧"
TOKEN_PATTERN = r"⟦([^_⟧]+)_(\d+)⟧"
HOLD = 48

# --- vaults and settings
VAULT_TTL_SECONDS = 24 * 3600
VAULT_KEY_DIGITS = 16
NO_SESSION = "default"
MODES = ("off", "shadow", "enforce")
MEMORY_VAULT = "memory"
NER_OFF = "off"
PROFILE = {"name": "default", "languages": ("he", "en"), "fail_mode": "open", "never_mask": (), "token_instruction": True, "alerts_on": ("unfiltered_sent", "leftover_token")}
MODE_FILE, PROFILE_FILE, NAMES_FILE, NER_URL_FILE, NER_SWITCH_FILE, VAULT_MODE_FILE, VAULT_FOLDER = "MODE", "profile.yaml", "gazetteer.txt", "ner_url", "ner.ctl", "vault_mode", "vaults"


def java(pattern: str) -> str:
    """The pattern for Spark: white space there lacks four separators, and named groups are written otherwise."""
    out, inside, at = [], False, 0
    pattern = pattern.replace("(?P<", "(?<")
    while at < len(pattern):
        pair = pattern[at : at + 2]
        if pair == r"\s":
            out.append(r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]")
        elif pair[0] == "\\":
            out.append(pair)
        else:
            inside = pair[0] == "[" or inside and pair[0] != "]"
            out.append(pair[0])
            at -= 1
        at += 2
    return "(?U)" + "".join(out)
