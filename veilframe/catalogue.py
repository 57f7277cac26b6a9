"""Patterns, word lists, weights, policies and dictionaries.

Everything under a "fixed values" comment has to be exactly so for results to
match; the rest of the package only reads these constants.
"""
from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """One catalogue row: a regular expression and what a hit on it means."""

    name: str
    regex: str
    label: str = ""
    priority: int = 0
    ignore_case: bool = False
    longest: int = 0  # longest possible match with single blanks; 0 is open
    needs: str = ""  # a character every match holds
    first: str = ""  # characters a match can begin with, as a class
    last: str = r"\s\S"  # characters a match can end with, as a class


# --- fixed values: free-text patterns, in matching order -------------------
TEXT_PATTERNS = [
    Pattern("EMAIL", r"\b[\w\.-]+@[\w\.-]+\.\w+\b"),
    Pattern("PHONE", r"\b(?:\+91[-\s]?)?[6-9]\d{9}\b"),
    Pattern("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    Pattern("AADHAAR", r"\b\d{4}\s\d{4}\s\d{4}\b"),
    Pattern("CREDIT_CARD", r"\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b"),
]

# A word boundary cannot precede "+", so the PHONE row above never covers the
# prefix. This optional row does.
PHONE_E164 = Pattern("PHONE", r"(?<![\w+])\+91[-\s]?[6-9]\d{9}\b")

# --- fixed values: phone numbers inside transcripts ------------------------
TRANSCRIPT_PHONE = Pattern("PHONE", r"\d{3}[-\s]?\d{3}[-\s]?\d{4}")

# --- fixed values: on-screen text classes; the first matching class wins ---
REGION_PATTERNS = [
    Pattern("PHONE_NUMBER", r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", ignore_case=True),
    Pattern("PHONE_NUMBER", r"\b\d{10}\b", ignore_case=True),
    Pattern("PHONE_NUMBER", r"\b\d{5}[-.\s]?\d{5}\b", ignore_case=True),
    Pattern("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", ignore_case=True),
    Pattern("ID_NUMBER", r"\b[A-Z]{1,2}\d{6,9}\b", ignore_case=True),
    Pattern("ID_NUMBER", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", ignore_case=True),
    Pattern("PERSON_NAME", r"\b(Mr\.|Mrs\.|Dr\.|Ms\.)\s[A-Z][a-z]+(?: [A-Z][a-z]+)?\b", ignore_case=True),
    Pattern("LOCATION", r"\b\d{1,4}[,\s]+[A-Za-z\s]+(Street|St|Avenue|Ave|Road|Rd|Lane|Blvd|Nagar|Colony)\b", ignore_case=True),
    Pattern("VEHICLE_PLATE", r"\b[A-Z]{2}[-\s]?\d{2}[-\s]?[A-Z]{1,2}[-\s]?\d{4}\b", ignore_case=True),
]

# --- fixed values: identifier catalogue for page tokens --------------------
ID_PATTERNS = [
    Pattern("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "B-DOC", 100, longest=10),
    Pattern("AADHAAR", r"\b\d{4}\s*\d{4}\s*\d{4}\b", "B-DOC", 95, longest=14),
    Pattern("AADHAAR", r"\b\d{12}\b", "B-DOC", 90, longest=14),
    Pattern("PASSPORT", r"\b[A-Z]\d{7}\b", "B-DOC", 85, longest=8),
    Pattern("DL", r"\b[A-Z]{2}[\s-]?\d{2}[\s-]?\d{11}\b", "B-DOC", 85, longest=17),
    Pattern("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "B-EMAIL", 90, needs="@"),
    Pattern("PHONE", r"\b\+91[\s-]?[6-9]\d{9}\b", "B-PHONE", 85, longest=14),
    Pattern("PHONE", r"\b[6-9]\d{9}\b", "B-PHONE", 75, longest=14),
    Pattern("DOB", r"\b\d{2}[/\-\.]\d{2}[/\-\.]\d{4}\b", "B-DATE", 85, longest=10),
    Pattern("DOB", r"\b\d{4}[/\-\.]\d{2}[/\-\.]\d{2}\b", "B-DATE", 80, longest=10),
    Pattern("CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "B-FINANCIAL", 85, longest=19),
    Pattern("PINCODE", r"\b[1-9]\d{5}\b", "B-LOC", 40, longest=6),
    Pattern("ADDRESS", r"\b\d{1,4}\s+[A-Za-z]+\s+(Street|St|Road|Rd|Lane|Ln|Nagar|Colony)\b", "B-LOC", 85, True, first=r"\d", last="tdenryTDENRY"),
    Pattern("GENERIC_ID", r"\b\d{10,15}\b", "B-SENSITIVE", 70, longest=15),
]

# --- fixed values: health catalogue ----------------------------------------
HEALTH_PATTERNS = [
    Pattern("MRN", r"\bMRN[:\s]*\d+\b", "B-HEALTH", 95, True, first="Mm"),
    Pattern("PATIENT_ID", r"\bPatient\s*ID[:\s]*\w+\b", "B-HEALTH", 95, True, first="Pp"),
    Pattern("BLOOD_GROUP", r"\bBlood\s*Group[:\s]*[ABO]{1,2}[+-]\b", "B-HEALTH", 80, True, first="Bb"),
    Pattern("DIAGNOSIS", r"\b(HIV|AIDS|Cancer|Diabetes|Tuberculosis|TB)\b", "B-HEALTH", 85, True, first="HACDThacdt"),
    Pattern("PRESCRIPTION", r"\bPrescription\s*No[:\s]*\w+\b", "B-HEALTH", 90, True, first="Pp"),
    Pattern("INSURANCE_ID", r"\bInsurance\s*ID[:\s]*\w+\b", "B-HEALTH", 90, True, first="Iiİı"),
]

# --- fixed values: older identifier catalogues, matched in running text ----
ID_PATTERNS_V1 = [
    Pattern("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "B-DOC"),
    Pattern("AADHAAR", r"\b(?:\d{4}\s\d{4}\s\d{4}|\d{12})\b", "B-DOC"),
    Pattern("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", "B-DOC"),
    Pattern("NINE_DIGIT", r"\b\d{9}\b", "B-DOC"),
    Pattern("UK_NI", r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]?\b", "B-DOC"),
    Pattern("PASSPORT", r"\b[A-Z]\d{7}\b", "B-DOC"),
    Pattern("DATE_SLASH", r"\b\d{2}/\d{2}/\d{4}\b", "B-DATE"),
    Pattern("DATE_DASH", r"\b\d{2}-\d{2}-\d{4}\b", "B-DATE"),
    Pattern("DATE_ISO", r"\b\d{4}-\d{2}-\d{2}\b", "B-DATE"),
    Pattern("POSTCODE", r"\b\d{5,7}\b", "B-LOC"),
]
ID_PATTERNS_V0 = [
    Pattern("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "B-DOC"),
    Pattern("AADHAAR", r"\b(?:\d{4}\s\d{4}\s\d{4}|\d{12})\b", "B-DOC"),
    Pattern("DOB", r"\b\d{2}[/\-]\d{2}[/\-]\d{4}\b", "B-DATE"),
    Pattern("PASSPORT", r"\b[A-Z]\d{7}\b", "B-DOC"),
    Pattern("PINCODE", r"\b[4-9]\d{5}\b", "B-LOC"),
]

# --- fixed values: identifiers replaced by a hash tag in feedback text -----
HASH_TAG_PATTERNS = [
    Pattern("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    Pattern("TWELVE_DIGIT", r"\b\d{12}\b"),
    Pattern("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
]

# --- fixed values: machine-readable zone -----------------------------------
MRZ_REGEX = r"[A-Z0-9<]{30,}"
MRZ_MIN_LENGTH = 25
MRZ_PRIORITY = {"PASSPORT_MRZ": 120, "MRZ": 100}

# --- fixed values: form labels whose neighbours are sensitive --------------
FIELD_LABELS = [
    Pattern("NAME_FIELD", r"^(name|नाम)$", "B-PER", 95, True),
    Pattern("FATHER_NAME", r"(father'?s?\s+name|पिता\s*का\s*नाम)", "B-PER", 95, True),
    Pattern("MOTHER_NAME", r"(mother'?s?\s+name|माता\s*का\s*नाम)", "B-PER", 95, True),
    Pattern("DOB_FIELD", r"(date\s+of\s+birth|dob|जन्म\s*तिथि)", "B-DATE", 90, True),
    Pattern("DIAGNOSIS_FIELD", r"(diagnosis|disease|condition)", "B-HEALTH", 90, True),
]
FIELD_LOOK_BACK, FIELD_LOOK_AHEAD, FIELD_VALUES = 10, 14, 3
FIELD_SEPARATORS = [":", "-", "/", "|", "."]

# --- fixed values: words that are never sensitive --------------------------
IGNORE_WORDS = [
    "gt", "lt", "mr", "ms", "dr", "st", "rd", "th", "nd", "am", "pm",
    "govt", "government", "india", "indian", "department", "of", "the",
    "ministry", "office", "card", "number", "date", "name", "male", "female",
    "permanent", "account", "income", "tax", "signature", "photo", "valid",
    "app", "keyword", "search", "this", "sp", "on", "to", "भारत", "सरकार",
    "form", "no", "page", "issue", "code", "type", "class", "श्री", "एसो",
    "google", "play", "android", "mobile", "apple", "store", "qr", "scan",
    "download", "digitally", "signe", "signed", "pan", "aadhaar", "gender",
    "dob", "father", "mother", "address", "birth",
]
NON_SENSITIVE_PHRASES = [
    "income tax", "govt of india", "government of india", "permanent account",
    "signature", "photo", "department", "ministry", "आयकर", "भारत सरकार",
    "date of birth", "father name", "mother name",
    "google play", "android", "mobile app", "qr code", "app store",
    "digitally sign", "scan", "download", "apple", "store",
]

# --- fixed values: upper-case name runs and name labels --------------------
NAME_STOPWORDS = [
    "REPUBLIC", "INDIA", "PLACE", "NAME", "SURNAME", "PASSPORT", "GOVERNMENT",
    "DATE", "BIRTH", "FATHER", "MOTHER", "LEGAL", "GUARDIAN", "HOLDER",
    "SIGNATURE", "ADDRESS", "OF", "THE", "AND",
]
NAME_LABEL_WORDS = ["name", "नाम", "name:", "surname", "given"]
NAME_LABEL_EXCLUDED = ["name", "नाम", "surname", "given"]

# --- fixed values: address keywords and the context kept around them -------
ADDRESS_KEYWORDS_V0 = [
    "road", "rd", "street", "st", "nagar", "colony", "sector", "lane", "plot",
    "building", "bldg", "flat", "apartment", "opp", "near", "behind", "block",
    "phase", "society", "mandir", "temple", "village", "village:", "town",
    "city", "district", "state", "maharashtra", "mumbai", "thane",
    "navi mumbai", "mumbai-", "india", "pin", "pincode",
]
ADDRESS_KEYWORDS_V1 = [
    "road", "rd", "street", "st", "nagar", "colony", "sector", "lane", "plot",
    "building", "bldg", "flat", "apartment", "opp", "near", "behind", "block",
    "phase", "society", "village", "town", "city", "district", "state",
    "province", "maharashtra", "mumbai", "pin", "pincode", "postcode", "zip",
    "zip code", "avenue", "boulevard",
]
ADDRESS_CONTEXT = {"v0": (40, 40), "v1": (40, 60)}

# --- fixed values: titles pulled into a person span ------------------------
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Adv.", "Shri", "Smt."]

# --- fixed values: entity labels accepted from models ----------------------
TEXT_ENTITY_LABELS = ["PERSON", "ORG", "GPE", "LOC", "DATE", "TIME", "NORP", "FAC"]
AUDIO_ENTITY_LABELS = ["PER", "ORG", "LOC"]

# --- fixed values: acceptance thresholds per label -------------------------
NER_THRESHOLDS = {"B-PER": 0.60, "B-LOC": 0.82, "B-DATE": 0.75}
NER_DEFAULT_THRESHOLD = 0.70
NER_THRESHOLD_RANGE = (0.2, 0.95)
NER_THRESHOLDS_V2 = {"B-PER": 0.45}
NER_VOTES, NER_SOLO_SCORE, NER_PRIORITY = 2, 0.85, 75

# --- fixed values: box rules in pixels -------------------------------------
BOX_MIN_SIDE, BOX_MAX_WIDTH, BOX_MAX_HEIGHT = 8, 800, 200
BOX_MAX_AREA, BOX_MAX_ASPECT = 50000, 30
BOX_MIN_SIDE_V0 = 6
BOX_PADDING = {"page": 5, "v1": 6, "v1_merge": 4, "photo": 10, "qr": 8}

# --- fixed values: overlay colours per label -------------------------------
OVERLAY_COLOURS = {
    "B-DOC": "255,0,0", "B-PER": "0,0,255", "B-LOC": "0,255,0",
    "B-DATE": "255,165,0", "B-PHONE": "255,0,255", "B-EMAIL": "0,255,255",
    "B-FINANCIAL": "255,255,0", "B-PHOTO": "148,0,211", "B-QR": "75,0,130",
}
OVERLAY_DEFAULT = "128,128,128"

# --- fixed values: OCR language codes --------------------------------------
LANGUAGE_CODES = {
    "en": "eng", "hi": "hin", "zh": "chi_sim", "es": "spa",
    "fr": "fra", "de": "deu", "it": "ita", "ja": "jpn",
}

# --- fixed values: redaction policies (faces, plates, pii, keep authorised) -
POLICIES = {
    "social_media": (True, True, False, False),
    "legal": (True, True, True, False),
    "surveillance": (True, False, False, True),
    "1": (True, False, False, False),
    "2": (False, True, True, False),
    "3": (True, True, True, False),
    "4": (True, False, False, True),
}

# --- fixed values: risk weights --------------------------------------------
RISK_CAP = 50
FRAME_RISK_POINTS = {
    "face": 2, "plate": 3, "phone_number": 4, "address": 5,
    "email_address": 3, "person_name": 4, "id_number": 5,
}
FRAME_RISK_DEFAULT = 1
REPORT_FACE_POINTS, REPORT_PLATE_POINTS = 2, 3
REPORT_TEXT_POINTS = [("phone", 4), ("address", 5), ("name", 4)]
REPORT_TEXT_DEFAULT = 3

# --- fixed values: video detectors and tracking ----------------------------
FACE_MIN_SCORE, FACE_MIN_SIDE = 0.55, 40
VEHICLE_CLASSES, VEHICLE_MIN_SCORE = [2, 3, 5, 7], 0.3
PLATE_SIDE_SHARE, PLATE_HEIGHT_SHARE = 0.2, 0.22
DETECTION_INTERVAL = 5
TRACK_IOU, TRACK_MAX_MISSED, TRACK_VELOCITY = 0.3, 2, 0.5
VOTE_IOU = 0.5
FACE_MATCH_DISTANCE = 0.5

# --- fixed values: audio ----------------------------------------------------
MIN_REPLACEMENT_MS = 300

# --- fixed values: feedback loop -------------------------------------------
CALIBRATION_MIN, CALIBRATION_LAST, CALIBRATION_KEEP, CALIBRATION_WEIGHT = 10, 50, 200, 0.3
DISABLE_PRECISION, DISABLE_SAMPLES = 0.40, 5
SHIFT_LABEL, SHIFT_PRECISION, SHIFT_VALUE = "B-LOC", 0.40, 0.30
RETENTION_DAYS = 7
GATE_MIN_SAMPLES, GATE_PROBABILITY = 20, 0.5
FEATURES = [
    "score", "priority", "rel_x", "rel_y", "rel_width", "rel_height",
    "word_len", "is_upper", "has_digit", "num_tokens", "label_id",
]

# Sentences of the example generators. Any frame around the number works.
PAN_TEMPLATES = [
    "the tax office filed {} as PAN", "income tax id PAN = {}", "quote PAN {} on every form",
    "{} (PAN) was verified",
]
AADHAAR_TEMPLATES = [
    "resident number Aadhaar = {}", "enrolled under Aadhaar {} last year", "{} (Aadhaar) was verified",
    "please bring Aadhaar {} along",
]
# --- fixed values: how many synthetic rows a training set takes -------------
SYNTHETIC_MIN, SYNTHETIC_RATIO = 50, 3

# Dictionaries behind pseudonyms and generated sentences. Any list works; the
# choice inside a list is a keyed hash of the original text.
FIRST_NAMES = [
    "Maya", "Arun", "Elena", "Tomas", "Leela", "Jonas", "Nadia", "Peter",
    "Ines", "Omar", "Clara", "Vikram", "Greta", "Samuel", "Divya", "Hugo",
    "Alma", "Rohan", "Tessa", "Karim", "Lena", "Anton", "Meera", "Oscar",
]
LAST_NAMES = [
    "Varma", "Lindqvist", "Okafor", "Moreau", "Castellan", "Novak", "Sethi",
    "Brandt", "Oliveira", "Tanaka", "Hollis", "Rao", "Keller", "Duarte",
    "Whitfield", "Banerjee", "Sorensen", "Nair", "Fontaine", "Adler",
]
CITIES = [
    "Larkspur", "Westbrook", "Port Selene", "Ashdale", "Kinmore", "Vellore",
    "Brightwater", "Oakhaven", "Madurai", "Stonebridge", "Elmsford", "Nashik",
]
COMPANIES = [
    "Bluefield Ltd", "Harbor & Sons", "Northlight Group", "Quarry Systems",
    "Sable Foods", "Tidewater Labs", "Umbra Textiles", "Willow Freight",
]
FILLER_WORDS = [
    "amber", "basin", "cedar", "delta", "ember", "fable", "grove", "harbour",
    "island", "jasper", "kernel", "lantern", "meadow", "nectar", "orchard",
    "pebble",
]
SYNTHETIC_STREET = "Lantern Lane"
SYNTHETIC_REGION = "Northern District"
SYNTHETIC_PINCODES = ["110203", "226417", "313042", "482915", "560388", "695214"]

# Which dictionary a label draws from at pseudonym level; others stay masked.
PSEUDONYM_KINDS = {
    "PERSON": "name", "GPE": "city", "LOC": "city", "DATE": "date",
    "ORG": "company", "EMAIL": "email", "PHONE": "phone",
}
PLACEHOLDER = "[REDACTED]"


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """Multiplication (10x10) and permutation (8x10) tables, row-major.

    The first is the dihedral group of order ten, the second the powers of one
    permutation; both are built from those rules.
    """
    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    row, powers = list(range(10)), []
    for _ in range(8):
        powers.extend(row)
        row = [row[step[j]] for j in range(10)]
    return [times(a, b) for a in range(10) for b in range(10)], powers
