"""Text functions as columns, inside code generation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a value narrative.
FUNCTION_WORDS = (
    "a an the this that these those such my your our their his her its it they them we you i me he she who whom which what "
    "to of in on at for with from by about into over under as than then and or but nor so yet if because while when where "
    "is are was were be been being am has have had do does did will would shall can could should may might must not no never"
).split()
# Words left out when the substance of two texts is compared.
STOPWORDS = (
    "the a an and or but not was were is are be been being to of in on at for with from by that this it its they them their you your we our us my me "
    "have has had do did does done as so if then than there here about into out over under can could will would should may no yes any some all one two get got"
).split()
# Openings that tell of the customer's state, not of a fault.
STATE_OPENINGS = ("the customer", "customer ", "customer's", "the user", "the client", "the complainant", "they feel", "they are feeling", "they're feeling", "user feels", "user is")

_EDGE = "(^|[^a-z0-9_])"
_END = "([^a-z0-9_]|$)"
MONEY = rf"[$£€]|{_EDGE}(dollars?|cents?|usd|aed|gbp){_END}"
DATE = rf"{_EDGE}[0-9]{{1,4}}[/-][0-9]{{1,2}}([/-][0-9]{{1,4}})?{_END}|{_EDGE}(19|20)[0-9]{{2}}{_END}|{_EDGE}xx[/-]xx{_END}|{_EDGE}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def snake(c: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def compose_name(head: Column, qualifier: Column) -> Column:
    """``qualifier_head``, or the head alone where the qualifier is null, empty or the head itself."""
    h, q = snake(head), snake(F.coalesce(qualifier, F.lit("")))
    return F.when((q != "") & (q != h), F.concat(q, F.lit("_"), h)).otherwise(h)


def split_qualifier(name: Column, head: Column) -> Column:
    """The qualifier of a composed name, or null."""
    suffix = F.concat(F.lit("_"), head)
    cut = name.substr(F.lit(1), F.length(name) - F.length(suffix))
    return F.when((name != head) & F.endswith(name, suffix) & (cut != ""), cut)


def value_kind(c: Column) -> Column:
    """Kind of a value: empty, money, date, redaction, clause, number, identifier or phrase, in this order of tests. Null counts as empty."""
    v = F.trim(F.coalesce(c, F.lit("")))
    low, t = F.lower(v), tokens(v)
    n = F.size(t)
    ratio = function_ratio(v)
    redacted = F.size(F.filter(t, lambda x: x.rlike("^x+$"))) / n
    digit = v.rlike("[0-9]")
    letter = low.rlike("[a-z]")
    return (
        F.when(n == 0, "empty")
        .when(low.rlike(MONEY), "money")
        .when(low.rlike(DATE), "date")
        .when(redacted >= 0.5, "redaction")
        .when(((n >= 6) & (ratio >= 0.25)) | ((n >= 4) & (ratio >= 0.4)), "clause")
        .when(digit & (n <= 5), F.when(letter, "identifier").otherwise("number"))
        .otherwise("phrase")
    )


def function_ratio(c: Column) -> Column:
    """Share of function words among the tokens; 0 without tokens."""
    t = tokens(c)
    words = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda x: F.array_contains(words, x))) / F.size(t))


def is_concrete(kind: Column) -> Column:
    """Whether a kind of value is a fact of its own."""
    return kind.isin("money", "date", "number", "identifier", "phrase")


def all_redacted(c: Column) -> Column:
    """Whether nothing but the placeholder letter x is left of the letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "").rlike("^x*$")


def grounded(value: Column, source: Column) -> Column:
    """Whether a value is in the source: as a whole, else by 0.6 of its tokens longer than two, else (none such) by any token. Blank values are not."""
    v, low = F.lower(F.trim(value)), F.lower(source)
    t = tokens(v)
    long = F.filter(t, lambda x: F.length(x) > 2)
    hits = F.size(F.filter(long, lambda x: F.contains(low, x)))
    return F.coalesce(
        F.when(v == "", False).when(F.contains(low, v), True).when(F.size(long) == 0, F.exists(t, lambda x: F.contains(low, x))).otherwise(hits / F.size(long) >= 0.6), F.lit(False)
    )


def extractive(qualifier: Column, source: Column) -> Column:
    """Whether a qualifier's words stand next to each other in the source."""
    phrase = F.replace(snake(qualifier), F.lit("_"), F.lit(" "))
    return F.coalesce((phrase != "") & F.contains(F.array_join(tokens(source), " "), phrase), F.lit(False))


def kept_qualifier(qualifier: Column, source: Column, most: int = 4) -> Column:
    """The qualifier in its normal form, or null if it is empty, longer than ``most`` words or not extractive."""
    q = snake(qualifier)
    return F.when((q != "") & (F.size(F.split(q, "_")) <= most) & extractive(qualifier, source), q)


def content_words(c: Column) -> Column:
    """Distinct words of three characters or more that carry substance, in order of the alphabet."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, x))))


def fault_grounded(fault: Column, text: Column, least: float = 0.4) -> Column:
    """Whether a fault is told in the text: not a state of the customer, and ``least`` of its content words are there."""
    state = F.lit(False)
    for s in STATE_OPENINGS:
        state = state | F.startswith(F.lower(F.trim(fault)), F.lit(s))
    words = content_words(fault)
    hits = F.size(F.array_intersect(words, content_words(text)))
    return F.coalesce(~state & (F.size(words) > 0) & (hits / F.size(words) >= least), F.lit(False))


def locate(value: Column, text: Column) -> Column:
    """Offset from 0 of a value in a text regardless of case, or null."""
    needle = F.lower(F.trim(value))
    at = F.call_function("instr", F.lower(text), needle)
    return F.when((needle != "") & (at > 0), at - 1)


def key_value(field: Column, value: Column) -> Column:
    """Normal form of an identifier: the digits of a phone, else lower case with single spaces. Phone fields are told by a whole word of the name between underscores."""
    phone = F.lower(field).rlike("(^|_)(phone|mobile|tel|cell|contact_number|msisdn)(_|$)")
    return F.when(phone, F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(F.trim(F.regexp_replace(value, "[ \\t\\n\\r]+", " "))))


def contact_name(field: Column) -> Column:
    """Whether a field's name says that it holds a contact."""
    return F.lower(field).rlike("(^|_)(phone|mobile|tel|cell|email|msisdn)(_|$)")


def identifier_name(field: Column) -> Column:
    """Whether a field's name reads like a reference of its own."""
    return F.lower(field).rlike("(^|_)(id|ref|reference|code|number|sku|barcode|ticket|uuid|guid)(_|$)")


def contact_value(value: Column) -> Column:
    """Whether a value has the shape of an e-mail address or a phone number."""
    return value.rlike(r"^[^@ \t\n]+@[^@ \t\n]+\.[^@ \t\n]+$") | value.rlike(r"^[+(]?[0-9][0-9 \t().-]{6,}$")


# Words of a field's name that bar it from the schema, by category in order of precedence.
SENSITIVE_WORDS = {
    "government_id": "ssn social_security passport passport_number drivers_license driver_license national_id tax_id ein state_id green_card visa_number",
    "payment_card": "card_number cardnumber cvv cvc ccv credit_card_number debit_card_number pan card_num expiry expiration_date security_code",
    "health": "diagnosis disease medical medical_record prescription medication disability pregnancy mental_health therapy hiv cancer illness patient blood_type allergy immunization vaccination",
    "biometric": "fingerprint biometric retina iris dna faceprint voiceprint",
    "credentials": "password passcode pin pin_number security_answer secret_question",
}


def sensitive_name(name: Column) -> Column:
    """Category of a protected field by its name, or null."""
    low, t = F.lower(name), tokens(name)
    flat = F.replace(low, F.lit("_"), F.lit(""))
    out = F.lit(None).cast("string")
    for category, words in reversed(SENSITIVE_WORDS.items()):
        listed = words.split()
        hit = F.arrays_overlap(t, F.array(*[F.lit(w) for w in listed]))
        if joined := "|".join(w.replace("_", "") for w in listed if "_" in w):
            hit = hit | flat.rlike(joined)
        out = F.when(hit, category).otherwise(out)
    return out


def card_numbers(c: Column) -> Column:
    """Digits of runs of 13 to 19 digits, single spaces or dashes between, that pass the Luhn check."""
    runs = F.regexp_extract_all(c, F.lit(r"[0-9](?:[ -]?[0-9]){12,18}"), F.lit(0))
    digits = F.transform(runs, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.filter(digits, lambda x: F.call_function("luhn_check", x))


def sensitive_value(c: Column) -> Column:
    """Category of a protected value by its shape, or null."""
    return F.when(c.rlike(r"(^|[^0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9A-Za-z_]|$)"), "government_id").when(F.size(card_numbers(c)) > 0, "payment_card")


def masked(c: Column) -> Column:
    """The text with e-mail addresses and runs of seven or more digits masked."""
    mail = F.regexp_replace(c, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "«redacted:email»")
    return F.regexp_replace(mail, r"\+?[0-9][0-9 \t\n\-().]{5,}[0-9]", "«redacted:digits»")


def masked_field(name: Column, value: Column) -> Column:
    """A value masked by its field: wholly where the name is a sensitive one, else as :func:`masked`."""
    return F.when(value.isNotNull() & sensitive_name(name).isNotNull(), "«redacted»").otherwise(masked(value))


def _signature(payload: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text's bytes, in base64 for addresses and without padding; composed of two hashes, so it stays in the engine."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    mac = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(payload, "UTF-8")), 256))), 256))
    return _url64(mac)


def _url64(raw: Column) -> Column:
    return F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))


def signed_token(payload: Column, secret: bytes) -> Column:
    """``payload.signature`` with the payload in base64 for addresses; null stays null. The secret must not be empty."""
    if not secret:
        raise ValueError("a secret is needed to sign")
    return F.concat(_url64(F.encode(payload, "UTF-8")), F.lit("."), _signature(payload, secret))


def token_payload(token: Column, secret: bytes) -> Column:
    """The payload of a token whose signature is right, else null."""
    plain = F.translate(F.substring_index(token, ".", 1), "-_", "+/")
    payload = F.decode(F.try_to_binary(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("=")), F.lit("base64")), "UTF-8")
    return F.when(signed_token(payload, secret) == token, payload)


def without_marks(c: Column) -> Column:
    """The text without direction marks and with plain spaces, trimmed."""
    return F.trim(F.translate(c, "\u202f\u00a0\u200e\u200f\u202a\u202b\u202c\u2066\u2067\u2068\u2069", "  "))


def fingerprint(c: Column, length: int | None = None) -> Column:
    """Near-duplicate key: without placeholders and digits, single spaces, lower case; of the whole text, or of its first ``length`` characters."""
    plain = F.regexp_replace(F.regexp_replace(c, "XX+|[0-9]+", ""), "[ \\t\\n\\r]+", " ")
    whole = F.trim(F.lower(plain))
    return whole if length is None else F.substring(whole, 1, length)


def meaningful(c: Column) -> Column:
    """The lines of a text but for blank ones and scanner boilerplate."""
    lines = F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~F.lower(x).rlike(r"scanned by |cam[ \t]?scanner|created with"))
    return F.trim(F.array_join(lines, "\n"))


def head_noun(c: Column) -> Column:
    """Last word of a name that is no number or ordinal, or null."""
    kept = F.filter(F.split(snake(c), "_"), lambda x: (x != "") & ~x.rlike("^[0-9]+(st|nd|rd|th)?$"))
    return F.when(F.size(kept) > 0, F.element_at(kept, -1))


def label(c: Column) -> Column:
    """A label in its normal form: null, blank and the word null are one empty label; ``none`` is a label of its own."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low == "null", "").otherwise(low)


# Media types of the file endings that intake sees.
MEDIA_TYPES = {
    "opus": "audio/ogg", "ogg": "audio/ogg", "m4a": "audio/mp4", "amr": "audio/amr", "mp3": "audio/mpeg", "wav": "audio/x-wav", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "png": "image/png", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "zip": "application/zip",
}


def media_type(filename: Column) -> Column:
    """Media type by the ending of a file's name; unknown ones are plain bytes."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    ending = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))).otherwise("")
    return F.coalesce(known[ending], F.lit("application/octet-stream"))


def media_branch(mime: Column) -> Column:
    """Normaliser that a media type goes to; unknown ones go nowhere, which is no error."""
    return F.when(F.startswith(mime, F.lit("text/")), "text").when(F.startswith(mime, F.lit("audio/")), "audio").when(F.startswith(mime, F.lit("image/")), "image").when(mime == "application/pdf", "pdf").otherwise("none")
