"""Masking personal data in text and reading labelled fields out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from .amounts import _as_col, lenient_amount, lenient_or_null, let, strip
from .text import joined_values

# --- fixed values: personal-data patterns ---------------------------------------------------
# word edges are spelled out: letters, digits and underscore of any script make a word
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ACCOUNT = "(?U)" + _START + r"\d{14}(\d{4})" + _END
CARD = "(?U)" + _START + r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?(\d{4})" + _END
TOKEN = _START + r"([A-Z0-9]{8,20})" + _END

# --- fixed values: labelled-field patterns (group 1 is the value) ---------------------------
VOUCHER_NUMBER = r"(?U)#\s*(\d{6,15})"
REFERENCE_NUMBER = (
    r"(?iuU)(?:N[úu]mero\s+de\s+referencia|Referencia\s+num[eé]rica|Referencia)[:\s]+(\d{5,15})"
)
HOUR = r"(?U)\b(\d{1,2}:\d{2})(?::\d{2})?\b"
MOTIVE = r"(?iuUd)(?:Motivo|Concepto)[:\s]+(.+?)(?:\n|$)"
CONCEPT = r"(?iuUd)(?:Concepto(?:\s+de\s+pago)?|Descripci[oó]n)[:\s]+(.+?)(?:\n|$)"
STATUS = r"(?iuUd)(?:Estatus|Estado|Status)[:\s]+(.+?)(?:\n|$)"
OPERATION = r"(?iuUd)(?:Tipo de operaci[oó]n|Operaci[oó]n)[:\s]+(.+?)(?:\n|$)"
MASKED_ACCOUNT = r"(?U)\*{4,7}(\d{4})"
TRACKING = r"(?iuU)(?:Clave de rastreo|CLABE rastreo|clave_rastreo)[:\s]+([A-Z0-9]{15,40})"
FOLIO = r"(?iuU)(?:Folio(?:\s+de\s+internet)?|FOLIO(?:\s+NUMERO)?)[:\s#]+([A-Z0-9]{4,20})"
TRANSACTION = (
    r"(?iuU)(?:N[°º]\.?\s*Transacci[oó]n|n[uú]mero\s+de\s+transacci[oó]n)[:\s#]+(\d{6,25})"
)
FEE = (
    r"(?iuU)(?:(?:TOTAL\s+)?COMISI[OÓ]N(?:\s+DEL\s+BANCO)?)[:\s]+"
    r"(?:M\.?N\.?\s*)?\$?\s*([\d,]+\.?\d*)"
)
VAT = r"(?iuU)\bIVA[:\s]+\$?\s*([\d,]+\.?\d*)"
ANY_AMOUNT = r"(?iuU)(?:Monto|Importe|Amount)[:\s]+\$?\s*([\d,\.]+)\s*(?:MXN|MN|USD)?"
NET_AMOUNT = r"(?iuU)(?:Importe\s+transferido|Importe\s+giro)[:\s]+\$?\s*([\d,]+\.?\d*)"
BASE_AMOUNT = r"(?iuUmd)^[\s\-]*MONTO\s*[:\s]+(?:M\.?N\.?\s*)?\$?\s*([\d,]+\.?\d*)"
TOTAL_AMOUNT = (
    r"(?iuU)(?:PAGO\s+TOTAL|Cantidad\s+Total|Importe\s+a\s+debitar)"
    r"[.:\s]+(?:M\.?N\.?\s*)?\$?\s*([\d,]+\.?\d*)"
)

_OPEN, _CLOSE = "\ue000", "\ue001"  # private-use marks around a matched code


def mask_accounts(text) -> Column:
    """18-digit accounts -> ``****`` and the last four digits."""
    return F.regexp_replace(_as_col(text), ACCOUNT, r"****$1")


def mask_cards(text) -> Column:
    """16-digit card numbers, grouped or not -> ``****`` and the last four digits."""
    return F.regexp_replace(_as_col(text), CARD, r"****$1")


def pseudonymize_tokens(text) -> Column:
    """Upper-case codes of 8-20 characters -> ``REF-`` and eight hash digits.

    Codes are marked in one pass, the text is split at the marks, and each piece rewritten, so
    the cost is linear in the text and a rewritten code is never matched again.
    """
    value = _as_col(text)
    pieces = F.split(F.regexp_replace(value, TOKEN, f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def rewrite(piece: Column, index: Column) -> Column:
        code = F.substring_index(piece, _CLOSE, 1)
        rest = F.substr(piece, F.length(code) + 2)
        hashed = F.concat(F.lit("REF-"), F.upper(F.left(F.sha2(code, 256), F.lit(8))), rest)
        return (
            F.when(index == 0, piece)
            .when(piece.contains(_CLOSE), hashed)
            .otherwise(F.concat(F.lit(_OPEN), piece))
        )

    return F.array_join(F.transform(pieces, rewrite), "")


def mask_personal_data(text) -> Column:
    """Accounts, then cards, then codes."""
    return pseudonymize_tokens(mask_cards(mask_accounts(text)))


def found(text, pattern: str) -> Column:
    """First match's value, null when there is none (a value is never empty)."""
    return F.nullif(F.regexp_extract(_as_col(text), pattern, 1), F.lit(""))


def found_or_blank(text, pattern: str) -> Column:
    return F.coalesce(found(text, pattern), F.lit(""))


def rest_of_line(text, pattern: str, default: str = "") -> Column:
    return F.coalesce(strip(found(text, pattern)), F.lit(default))


def masked_account(text, position: int) -> Column:
    """The ``position``-th masked account suffix (0 = sender, 1 = receiver), blank if absent."""
    found_all = F.regexp_extract_all(_as_col(text), F.lit(MASKED_ACCOUNT))
    suffix = F.get(found_all, position)
    return F.coalesce(F.concat(F.lit("****"), suffix), F.lit(""))


def _field(name) -> Column:
    return F.coalesce(_as_col(name), F.lit(""))


def hour_of(hora, fecha, text) -> Column:
    """Captured hour, else one inside the date field, else one in the text, else blank."""
    given = F.nullif(_field(hora), F.lit(""))
    return F.coalesce(given, found(_field(fecha), HOUR), found(text, HOUR), F.lit(""))


def _nonzero(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def both_amounts(importe_base, monto, text) -> Column:
    """``net`` and ``total`` as a struct.

    Net: captured base, else the transfer label, else the MONTO line, else the captured amount.
    Total: total label, else a captured amount that differs from the net one, else the net one.
    """
    captured = lenient_amount(monto)
    net = F.coalesce(
        _nonzero(lenient_amount(importe_base)),
        lenient_or_null(found(text, NET_AMOUNT)),
        lenient_or_null(found(text, BASE_AMOUNT)),
        captured,
    )
    parts = F.struct(
        net.alias("net"),
        captured.alias("captured"),
        lenient_or_null(found(text, TOTAL_AMOUNT)).alias("labelled"),
    )

    def settle(p: Column) -> Column:
        differs = (p["captured"] != 0) & (p["captured"] != p["net"])
        fallback = F.when(differs, p["captured"]).otherwise(p["net"])
        return F.struct(
            p["net"].alias("net"), F.coalesce(p["labelled"], fallback).alias("total")
        )

    return let(parts, settle)


def net_amount(importe_base, monto, text) -> Column:
    return both_amounts(importe_base, monto, text)["net"]


def total_amount(importe_base, monto, text) -> Column:
    return both_amounts(importe_base, monto, text)["total"]


def truth_records(
    df: DataFrame, image_id, document_text, fields: dict[str, Column], into: str = "registro"
) -> DataFrame:
    """Add a ground-truth stub (struct) built from captured fields plus the document's own text.

    ``fields`` maps captured names (monto, importe_base, fecha, hora, referencia,
    numero_operacion, banco) to columns. Personal fields stay blank. The texts and the values
    read from them are staged as columns, so each pattern runs once per row.
    """
    get = {key: _as_col(fields[key]) for key in vocab.RESPONSE_KEYS}
    doc, raw, narrow = F.col("__doc"), F.col("__raw"), F.col("__narrow")

    def with_doc(tail: Column) -> Column:
        return F.when(doc != "", strip(F.concat(doc, F.lit(" "), tail))).otherwise(tail)

    def blank(value) -> Column:
        return F.nullif(_as_col(value), F.lit(""))

    staged = (
        df.withColumn("__doc", _field(document_text))
        .withColumns(
            {
                "__raw": with_doc(F.concat_ws(" ", *[get[key] for key in vocab.RESPONSE_KEYS])),
                "__narrow": with_doc(_field(get["referencia"])),
            }
        )
        .withColumns(
            {
                "__folio": found(raw, FOLIO),
                "__amount": lenient_amount(get["monto"]),
                "__rescued": lenient_or_null(found(doc, ANY_AMOUNT)),
                "__both": both_amounts(get["importe_base"], get["monto"], raw),
                "__fee": lenient_amount(found(raw, FEE)),
                "__vat": lenient_amount(found(raw, VAT)),
                "__masks": F.regexp_extract_all(narrow, F.lit(MASKED_ACCOUNT)),
                "__motive": strip(found(narrow, MOTIVE)),
                "__concept": strip(found(raw, CONCEPT)),
                "__status": strip(found(raw, STATUS)),
                "__operation": strip(found(raw, OPERATION)),
            }
        )
    )
    reference = _field(get["referencia"])
    number = F.coalesce(
        found(narrow, VOUCHER_NUMBER),
        blank(get["numero_operacion"]),
        F.col("__folio"),
        found(raw, TRANSACTION),
        F.when(strip(reference).rlike(r"^\d+$"), reference),
        F.lit(""),
    )

    def mask(position: int) -> Column:
        return F.coalesce(F.concat(F.lit("****"), F.get("__masks", F.lit(position))), F.lit(""))

    def kept(name: str, default: str = "") -> Column:
        return F.coalesce(name, F.lit(default))

    extended = F.struct(
        found_or_blank(raw, TRACKING).alias("clave_rastreo"),
        kept("__concept").alias("concepto"),
        F.col("__fee").alias("comision"),
        F.col("__vat").alias("iva"),
        F.lit(0.0).alias("iva_comision"),
        kept("__folio").alias("folio"),
        F.lit("").alias("nombre_ordenante"),
        F.lit("").alias("nombre_beneficiario"),
        F.lit("").alias("rfc_ordenante"),
        kept("__status", "exitosa").alias("estatus"),
        kept("__operation").alias("tipo_operacion"),
        F.col("__both.net").alias("importe_transferido"),
        F.col("__both.total").alias("importe_total"),
        F.lit("MX").alias("pais"),
    )
    record = F.struct(
        F.lit("2.0").alias("schema_version"),
        _as_col(image_id).alias("id"),
        F.coalesce(blank(get["banco"]), F.lit("DESCONOCIDO")).alias("banco_emisor"),
        F.lit("").alias("banco_receptor"),
        F.coalesce(_nonzero(F.col("__amount")), "__rescued", F.lit(0.0)).alias("monto"),
        F.lit("MXN").alias("moneda"),
        _field(get["fecha"]).alias("fecha"),
        hour_of(get["hora"], get["fecha"], narrow).alias("hora"),
        number.alias("numero_comprobante"),
        found_or_blank(narrow, REFERENCE_NUMBER).alias("numero_referencia"),
        kept("__motive").alias("motivo"),
        mask(0).alias("clabe_emisor_mascara"),
        mask(1).alias("clabe_receptor_mascara"),
        F.lit("spei_recibido").alias("tipo"),
        F.lit("screenshot_movil").alias("formato_origen"),
        F.lit("buena").alias("calidad"),
        F.lit("").alias("notas"),
        extended.alias("extended"),
    )
    return staged.select(*df.columns, record.alias(into))


def assembled_text(*values) -> Column:
    """Plain text of a capture: its non-blank values joined by one space."""
    return joined_values(*values)
