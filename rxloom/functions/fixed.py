"""Patterns, word lists and tables that results depend on.

Patterns are written for RE2 and Java alike, without flags; ``icase`` adds them.
"""

# --- fixed values ---------------------------------------------------------------

DOSAGE = r"\b(\d[\d,]*(?:\.\d+)?)\s*(mg|mcg|g\b|ml|iu|gm|mmol|meq|%)\b"

# (pattern, days for one unit), in order of trial
DURATIONS = [
    (r"x\s*(\d+)\s*(?:day|d\b)", 1),
    (r"(?:for\s+)?(\d+)\s*day(?:s)?\b", 1),
    (r"(?:for\s+)?(\d+)\s*week(?:s)?\b", 7),
    (r"(?:for\s+)?(\d+)\s*month(?:s)?\b", 30),
    (r"(\d+)\s*/\s*7\b", 1),
    (r"(\d+)\s*/\s*52\b", 1),
    (r"(\d+)\s*/\s*12\b", 1),
    (r"\b(\d{1,2})\s*d(?:ays?)?\b", 1),
]

DOCTOR = r"(?:Dr\.?|Doctor|Physician|Consultant|Prof\.?)\s+([A-Z][A-Za-z'\-\.]+(?:\s+[A-Z][A-Za-z'\-\.]+){0,3})"
PATIENT = r"(?:Patient|Pt\.?|Name)\s*[:\-]\s*([A-Z][A-Za-z'\-\.]+(?:\s+[A-Z][A-Za-z'\-\.]+){0,3})"
DATE = r"\b(\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}|\d{2,4}[-/\.]\d{1,2}[-/\.]\d{1,2})\b"
HOSPITAL = r"(?:Hospital|Clinic|Centre|Center|Medical|Nursing|Health)\b[^,\n]{0,40}"

NOISE = [
    r"^\s*(?:tel|ph|phone|fax|mob|email|www|http|address|reg\.?\s*no)[\s:\.]+",
    r"^\s*[*#]{3,}",
    r"^\s*[_\-]{4,}",
    r"^\s*page\s+\d",
]

FORM_PREFIX = (
    r"^\s*(?:tab(?:let)?s?\.?|cap(?:sule)?s?\.?|inj(?:ection)?s?\.?|syr(?:up)?\.?|susp(?:ension)?\.?|oint(?:ment)?\.?|"
    r"drop[s]?\.?|gel\.?|cream\.?|lotion\.?|spray\.?|patch\.?|sach(?:et)?s?\.?|granules?\.?|powder\.?)\s+"
)
HINT = (
    r"\b(?:tab(?:let)?|cap(?:sule)?|inj(?:ection)?|syr(?:up)?|susp(?:ension)?|drop|mg|mcg|ml|iu|od|bd|tds|qid|bid|tid|hs|sos|prn|am|pm)\b|"
    r"\b\d\s*[-–]\s*\d\s*[-–]\s*\d\b"
)

POSITIONAL = r"\b(\d)\s*[-–]\s*(\d)\s*[-–]\s*(\d)\b"
POSITIONAL_TIMES = ["08:00", "13:00", "20:00"]
SCORED_CODES = ["OD", "BD", "TDS", "QID", "BID", "TID", "SOS", "PRN", "HS", "Q4H", "Q6H", "Q8H", "Q12H", "STAT"]
SPAN_WORDS = r"\d+\s*(?:day|week|month)s?\b"
NUMBERED = r"^\s*\d+[\.\)]\s+\S"
BULLETED = r"^\s*[-•*]\s+\S"
HEADER_MARKS = r"\d{10}|\bwww\b|@|address|signature"

# (ord, code, full name, times a day, times)
FREQUENCIES = [
    (1, "OD", "Once Daily", 1, ["08:00"]),
    (2, "QD", "Once Daily", 1, ["08:00"]),
    (3, "BD", "Twice Daily", 2, ["08:00", "20:00"]),
    (4, "BID", "Twice Daily", 2, ["08:00", "20:00"]),
    (5, "TDS", "Thrice Daily", 3, ["08:00", "13:00", "20:00"]),
    (6, "TID", "Thrice Daily", 3, ["08:00", "13:00", "20:00"]),
    (7, "QID", "Four Times Daily", 4, ["08:00", "12:00", "16:00", "20:00"]),
    (8, "HS", "At Bedtime", 1, ["22:00"]),
    (9, "SOS", "As Needed", 0, []),
    (10, "PRN", "As Needed", 0, []),
    (11, "STAT", "Immediately", 1, []),
    (12, "AC", "Before Meals", 3, ["07:30", "12:30", "19:30"]),
    (13, "PC", "After Meals", 3, ["09:00", "14:00", "21:00"]),
    (14, "AM", "Morning", 1, ["08:00"]),
    (15, "PM", "Evening", 1, ["18:00"]),
    (16, "Q4H", "Every 4 Hours", 6, ["06:00", "10:00", "14:00", "18:00", "22:00", "02:00"]),
    (17, "Q6H", "Every 6 Hours", 4, ["06:00", "12:00", "18:00", "00:00"]),
    (18, "Q8H", "Every 8 Hours", 3, ["06:00", "14:00", "22:00"]),
    (19, "Q12H", "Every 12 Hours", 2, ["08:00", "20:00"]),
    (20, "WEEKLY", "Once Weekly", 0, ["09:00"]),
]

# (pattern, code), first match wins; the first rule also takes "daily" where DAILY_BUT does not follow
PHRASES = [
    (r"\bonce\s+(?:a\s+)?(?:day|daily)\b|\bod\b|\bqd\b", "OD"),
    (r"\btwice\s+(?:a\s+)?day\b|\bbd\b|\bbid\b|\btwo\s+times\b|\b2\s*times\b", "BD"),
    (r"\bthree\s+times\b|\bthrice\b|\btds\b|\btid\b|\b3\s*times\b", "TDS"),
    (r"\bfour\s+times\b|\bqid\b|\b4\s*times\b", "QID"),
    (r"\bat\s+bed\s*time\b|\bbedtime\b", "HS"),
    (r"\bas\s+needed\b|\bwhen\s+req(?:uired)?\b|\bsos\b|\bprn\b", "SOS"),
    (r"\bq4h\b|\bevery\s+4\s+hours?\b", "Q4H"),
    (r"\bq6h\b|\bevery\s+6\s+hours?\b", "Q6H"),
    (r"\bq8h\b|\bevery\s+8\s+hours?\b", "Q8H"),
    (r"\bq12h\b|\bevery\s+12\s+hours?\b", "Q12H"),
    (r"\bweekly\b|\bonce\s+(?:a\s+)?week\b", "WEEKLY"),
    (r"\bmorning\s+only\b|\bevery\s+morning\b", "AM"),
    (r"\bevening\s+only\b|\bevery\s+evening\b", "PM"),
    (r"\bonce\b", "OD"),
]
DAILY = r"\bdaily\b"
DAILY_BUT = r"\s+twice|\s+thrice|\s+four"

# (pattern, note), first match wins
TIMINGS = [
    (r"before\s+break\s*fast", "Before breakfast"),
    (r"after\s+break\s*fast|with\s+break\s*fast", "After breakfast"),
    (r"before\s+lunch", "Before lunch"),
    (r"after\s+lunch|with\s+lunch", "After lunch"),
    (r"before\s+dinner", "Before dinner"),
    (r"after\s+dinner|with\s+dinner", "After dinner"),
    (r"before\s+food|ac\b|empty\s+stomach", "Before food"),
    (r"after\s+food|pc\b|with\s+meal|with\s+food", "After food"),
    (r"at\s+bed\s*time|before\s+sleep|hs\b", "Before sleep"),
    (r"with\s+water", "With water"),
    (r"on\s+empty\s+stomach", "Empty stomach"),
    (r"sublingually?", "Under tongue"),
    (r"after\s+meal", "After meal"),
]

# (misread, meant)
MISREADS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("2", "z"), ("4", "a"), ("5", "s"), ("6", "g"),
    ("7", "t"), ("8", "b"), ("9", "g"), ("|", "l"), ("vv", "w"), ("rn", "m"), ("cl", "d"),
]
LINK_PREFIX = (
    r"^\s*(?:tab(?:let)?s?\.?|cap(?:sule)?s?\.?|inj(?:ection)?\.?|syr(?:up)?\.?|oint(?:ment)?\.?|drop[s]?\.?|"
    r"sach(?:et)?s?\.?|susp(?:ension)?\.?|gel\.?|cream\.?|lotion\.?|patch\.?|spray\.?)\s+"
)
LINK_DOSAGE = r"\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|%|mmol)\b.*$"
LINK_NUMBER = r"\s+\d{4,}\b.*$"

NAME_KEYS = ["medicine_name", "medicine", "drug_name", "drug", "name"]
DOSAGE_KEYS = ["dosage", "dose", "strength"]
FREQUENCY_KEYS = ["frequency", "frequency_code", "freq", "schedule"]
DURATION_KEYS = ["duration", "duration_days", "days"]
NOTE_KEYS = ["timing_note", "timing_notes", "instructions", "instruction", "note"]

MEDIA_TYPES = ["image/jpeg", "image/png", "image/webp", "image/bmp", "image/tiff"]

LOW_CONFIDENCE = "Low OCR confidence (%s). Results may be inaccurate — please review carefully."
LENIENT_USED = "Automatic fallback extraction was used due to weak OCR signal. Please verify medicine names before confirming reminders."
UNMATCHED = "%s medicine(s) could not be matched to the database. Please verify the names."
NONE_FOUND = "No medicines could be extracted. The image may be unclear or not a prescription."
MODEL_USED = "Donut fallback OCR was used to recover low-confidence handwriting. Please review medicines before confirming reminders."

# --- end of fixed values ----------------------------------------------------------
