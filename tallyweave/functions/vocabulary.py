"""Words, patterns and constants of ledgers."""

# Header words by column, in the order in which they are tried; all words of an entry must be in the label.
HEADER_WORDS = (
    ("date", ("date", "posting", "trans date", "value date")),
    ("description", ("description", "desc", "descr", "details", "memo", "particulars", "narrative", "transaction", "reference", "payee", "name")),
    ("type", ("type",)),
    ("num", ("num",)),
    ("debit", ("debit", "withdrawal", "withdrawals", "payment", "payments", "money out", "funds out", "dr", "charge")),
    ("credit", ("credit", "deposit", "deposits", "money in", "funds in", "cr", "receipt")),
    ("balance", ("balance",)),
    ("amount", ("amount",)),
    ("account", ("account",)),
)
TEXT_COLUMNS = ("type", "date", "num", "description", "account")
MONEY_COLUMNS = ("debit", "credit", "amount", "balance")
COLUMNS = TEXT_COLUMNS + MONEY_COLUMNS
EXPORT_COLUMNS = ("type", "date", "num", "description", "account", "debit", "credit", "amount", "balance", "flag", "llm_classification")
OPTIONAL_COLUMNS = ("type", "num", "account")

# Patterns.
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?"
DATE_PIECE = rf"(?i)^(?:\d[\d/.\-]*,?|{_MONTH})$"
DATE_WORD = rf"(?i)^(?:\d{{1,4}}[/.\-]\d{{1,2}}(?:[/.\-]\d{{1,4}})?|{_MONTH})$"
FULL_DATE = r"^\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}$"
DATE_LIKE = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\s*[A-Za-z]{3,9}\s*\d{0,4}|[A-Za-z]{3,9}\s+\d{1,2}"
WORDY = r"[A-Za-z]{2,}"
MARKER = r"^\(?(?:CR|DR|DB|Cr|Dr)\)?\.?$"
OCR_NUMBER = r"^(?:[($\-]*[\dOoIl|.,]*\d[\dOoIl|.,]*[)\-]*|[oO]{1,3}[.,][oO]{2})$"
PAIR = r"([A-Za-z][A-Za-z .#/'-]{0,28}?)\s*(?<!\d)[:•](?!\d)\s*(.+?)(?=\s+[A-Za-z][A-Za-z .#/'-]{0,28}?\s*(?<!\d)[:•](?!\d)\s|$)"

# Constants.
TOLERANCE = "0.02"
TEXT_LAYER_CHARS = 40
PREVIEW_CHARS = 2000
HEADER_ROWS = 10
SKEW_DEGREES = 0.3
TEXT_HEIGHT, LEAST_HEIGHT, MOST_ZOOM = 28, 20, 3.0
IMAGE_KINDS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp", ".heic", ".heif")
GRID_KINDS = (".xlsx", ".xlsm", ".docx")
ENGINES = ("winocr", "tesseract")
LEAST_REREAD = 0.8

# What a result says.
NO_ENGINE = "This is a scan or photo, and no local OCR engine was found (Windows OCR or Tesseract)."
NO_HEIC = "HEIC/HEIF photos need the optional 'pillow-heif' package. Or convert the photo to JPG/PNG."
SAID_TEXT = "Plain text extracted."
SAID_TABLE = "A table was found (not a ledger, so no balance check)."
SAID_NOTHING = "No table was detected, so the full text was extracted."
