"""Fixed values shared by every module: closed vocabularies, limits and thresholds."""

from __future__ import annotations

# --- fixed values: closed vocabularies -------------------------------------------------
STATES = (
    "recibido",
    "procesando",
    "comparando",
    "sospechoso",
    "en_revision",
    "valido",
    "duplicado",
    "error",
)
CLASSES = ("valido", "sospechoso", "duplicado")
METHODS = ("hash_exacto", "campos_exactos", "scoring_ponderado", "manual")
ROLES = ("admin", "operador", "auditor")
PLANS = ("basic", "pro", "enterprise")
ORG_PLANS = ("basico", "profesional", "empresarial")
LOG_LEVELS = ("INFO", "WARN", "ERROR")

# --- fixed values: legal state transitions (from, to) -----------------------------------
TRANSITIONS = (
    ("recibido", "procesando"),
    ("recibido", "error"),
    ("procesando", "comparando"),
    ("procesando", "error"),
    ("comparando", "valido"),
    ("comparando", "sospechoso"),
    ("comparando", "duplicado"),
    ("comparando", "en_revision"),
    ("comparando", "error"),
    ("en_revision", "valido"),
    ("en_revision", "duplicado"),
    ("en_revision", "error"),
    ("sospechoso", "en_revision"),
    ("error", "recibido"),
)

# --- fixed values: review actions, display severity, plan limits (-1 = unlimited) --------
ACTION_TO_STATE = {"aceptar": "valido", "rechazar": "duplicado"}
SEVERITY = {
    "valido": "success",
    "sospechoso": "warning",
    "en_revision": "warning",
    "duplicado": "error",
    "error": "error",
    "recibido": "info",
    "procesando": "info",
    "comparando": "info",
}
PLAN_LIMITS = {"basic": 50, "pro": 500, "enterprise": -1}

# --- fixed values: limits and labels ------------------------------------------------------
MAX_DOCUMENT_BYTES = 10 * 1024 * 1024
MAX_PAGE = 100
HASH_TTL = "7 days"
ALLOWED_EXTENSIONS = ("png", "jpg", "jpeg", "pdf")
MIME_TO_EXT = {"image/png": "png", "image/jpeg": "jpg", "application/pdf": "pdf"}
RESPONSE_KEYS = (
    "monto",
    "importe_base",
    "fecha",
    "hora",
    "referencia",
    "numero_operacion",
    "banco",
)

PAIR_COLUMNS = (
    "id_a",
    "id_b",
    "tipo_duplicado",
    "capa_esperada",
    "clasificacion_esperada",
    "notas",
)
ACCURACY_COLUMNS = (
    "image_id",
    "gt_total",
    "gt_date",
    "pred_total",
    "pred_date",
    "match_total",
    "match_date",
    "error",
)
EXPECTED_LABELS = ("duplicado_exacto", "duplicado_parcial", "no_duplicado")
PREDICTED_LABELS = ("duplicado", "sospechoso", "valido")
POSITIVE_LABELS = ("duplicado_exacto", "duplicado_parcial")
PAIR_SHARES = {"exacto": 0.30, "parcial_visual": 0.40, "negativo": 0.30}
PAIR_TOLERANCE = 0.05
MIN_PAIRS = 50

# --- fixed values: bank catalogue, canonical name -> aliases in match order ----------------
BANK_ALIASES = (
    ("BBVA", ("bbva", "bbvabancomer", "bancomer")),
    ("Citibanamex", ("citibanamex", "banamex", "citibanex", "citi")),
    ("Banorte", ("banorte",)),
    ("HSBC", ("hsbc",)),
    ("Santander", ("santander",)),
    ("Hey Banco", ("heybanco", "hey")),
    ("Nu Bank", ("nubank", "nu")),
)
BANK_OTHER = "OTRO"
BANK_MIN_RATIO = 0.85
BANK_SUBSTRING_MIN = 4

# --- fixed values: spelling -> canonical bank for labelled data ----------------------------
BANK_SPELLINGS = {
    "Mercado Pago WALLET": "Mercado Pago",
    "WALLET": "Mercado Pago",
    "Mercado Pago": "Mercado Pago",
    "BBVA Bancomer": "BBVA",
    "BBVA BANCOMER": "BBVA",
    "BANCOMER": "BBVA",
    "BBVA": "BBVA",
    "BANAMEX": "Banamex",
    "Banamex": "Banamex",
    "Citibanamex": "Banamex",
    "Santander": "Santander",
    "BANORTE": "Banorte",
    "Banorte": "Banorte",
    "SCOTIABANK": "Scotiabank",
    "SCTIABANK": "Scotiabank",
    "Scotiabank": "Scotiabank",
    "Banco Azteca": "Banco Azteca",
    "OXXO": "OXXO",
    "BanCoppel": "BanCoppel",
    "BANCOPPEL": "BanCoppel",
}

# --- fixed values: Spanish month names, English month prefixes ------------------------------
MONTHS_ES = (
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO",
    "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
)
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# --- fixed values: scoring defaults ----------------------------------------------------------
DEFAULT_WEIGHTS = {"w_ref": 0.35, "w_text": 0.30, "w_monto": 0.20, "w_fecha": 0.15}
WEIGHT_KEYS = {
    "scoring.w_ref": "w_ref",
    "scoring.w_text": "w_text",
    "scoring.w_monto": "w_monto",
    "scoring.w_fecha": "w_fecha",
}
DUPLICATE_AT = 0.90
SUSPECT_AT = 0.75
WINDOW_DAYS = 30
