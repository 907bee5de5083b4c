"""Columns over text: lines, redaction, snippets. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from .patterns import java

# Line boundaries.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: All of them but the usual one.
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# White space at the ends of a line.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Words that make an assignment's key a secret.
SECRET_WORDS = "password|passwd|pwd|token|secret|api_key|access_key"
# Patterns are in Python's syntax and sense; java() prints them for the JVM.
SECRET_KEY = rf"\b(?:[A-Za-z_][A-Za-z0-9_]*)?(?:{SECRET_WORDS})[A-Za-z0-9_]*\b"
ASSIGNED = rf"""(?:"{SECRET_KEY}"|'{SECRET_KEY}'|{SECRET_KEY})\s*[:=]\s*"""
#: Quoted values, escapes included; nothing inside can be given back, so the repetition is possessive.
DOUBLE, SINGLE = r'"[^"\\\r\n]*+(?:\\.[^"\\\r\n]*+)*+"', r"'[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+'"
ASSIGNMENT = rf"(?i){ASSIGNED}(?:{DOUBLE}|{SINGLE}|[^\s#,;]+)"
# Shapes of credentials. Where only a part is shown, it is a group.
PRIVATE_KEY = r"(?s)-----BEGIN ((?:[A-Z0-9 ]+ )?PRIVATE KEY)-----.*?(?:-----END \1-----|$)"
API_KEY = r"\b(sk-)[A-Za-z0-9_-]{12,}([A-Za-z0-9_-]{4})\b"
GIT_TOKEN = r"\b(gh[pousr]_)[A-Za-z0-9]{16,}([A-Za-z0-9]{4})\b"
CLOUD_KEY = r"\b(AKIA|ASIA)[A-Z0-9]{12}([A-Z0-9]{4})\b"
_TOKEN = "[A-Za-z0-9._~+/=-]"
BEARER = rf"(?i)\bBearer\s+(?={_TOKEN}{{12}})((?-i:sk-|AKIA|ASIA|gh..)|{_TOKEN}{{2}}){_TOKEN}*({_TOKEN}{{4}})"
URL_LOGIN = r"(?i)(\b[a-z][a-z0-9+.-]*://)[^/@\s]+@"
#: All patterns of redaction.
REDACTED = (PRIVATE_KEY, ASSIGNMENT, API_KEY, GIT_TOKEN, CLOUD_KEY, BEARER, URL_LOGIN)
# Characters that are shown as escapes.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"

#: A cheap superset of everything that redaction changes, but for control characters.
#: The look ahead at the first character settles most places at once.
MAYBE_SECRET = rf"(?i)(?=[ptsagb:])(?:{SECRET_WORDS}|sk-|gh[pousr]_|AKIA|ASIA|Bearer|://[^/@\s]+@|PRIVATE KEY)"
#: The same in two parts: plain texts, and what may be a login.
SECRET_TEXTS, MAYBE_LOGIN = rf"(?i)(?:{SECRET_WORDS}|sk-|ghp_|gho_|ghu_|ghs_|ghr_|AKIA|ASIA|Bearer|PRIVATE KEY)", r"://[^/@\s]+@"
#: What stands before an assignment, and the assignment, empty for the rest of the text.
TO_ASSIGNMENT = rf"((?s:.)*?)({ASSIGNMENT.removeprefix('(?i)')}|\Z)"


GIT_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
#: Characters beyond plain text. Without them the JVM's own classes, boundaries and cases are Python's; (?d) sets the end of a line.
UNPLAIN = r"[^\t\n\r -~]"
#: What shows that redaction may change a plain text. Each sign is told by its rarest letter, as most places of a text fail there.
SIGN = (
    r"(?=[wWkKbBcC_:S])(?:[wW](?<=(?i:passw|pw))|[kK](?:(?<=(?i:tok|api_k|access_k))[eE]|(?<=sk)-|(?<=AK)I|(?<=PRIVATE K)E)|[bB](?i:earer)"
    r"|[cC](?i:ret)(?<=(?i:secret))|_(?<=gh[pousr]_)|://[^/@\s]+@|S(?<=AS)IA)"
)
#: Characters that no plain text holds: one between texts that are redacted together, and two around the value of an assignment.
BETWEEN, OPEN, CLOSE = "\x01", "\x02", "\x03"
#: An assignment in plain texts: what stands before its value, then the quote and the value, or the value alone. Like the patterns
#: for any text, but that nothing goes beyond the text in which it begins.
_VALUES = [rf"({q})([^{q}\\\r\n{BETWEEN}]*+(?:\\[^\n{BETWEEN}][^{q}\\\r\n{BETWEEN}]*+)*+){q}" for q in "\"'"]
PLAIN_ASSIGNMENT = rf"(?id)({ASSIGNED})(?:{_VALUES[0]}|{_VALUES[1]}|([^\s#,;{BETWEEN}]+))"
PLAIN_LOGIN = rf"(?i)(\b[a-z][a-z0-9+.-]*://)[^/@\s{BETWEEN}]+@"
#: What shows that a plain text may hold one of the known shapes.
SHAPES = r"sk-|gh[pousr]_|A(?:KIA|SIA)|[bB](?i:earer)|://"


def split_lines(content: Column) -> Column:
    """Array of lines without their breaks; no empty line after a final break; empty content has no line.

    Few files hold a break other than a line feed, and what they don't hold is looked for without a pattern; a split by one
    plain character needs none either.
    """
    rare = reduce(Column.__or__, [content.contains(c) for c in RARE_BREAKS])
    lines = F.when(rare, F.split(content, LINE_BREAK, -1)).otherwise(F.split(content, "\n", -1))
    return bound(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def strip(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def strip_named(line: Column) -> Column:
    """strip of a column, which costs nothing to be named again: what begins and ends with a visible ASCII character stays."""
    seen = lambda place: F.substring(line, place, 1).between("!", "~")
    return F.when(seen(1) & seen(-1), line).otherwise(strip(line))


def mask_secret(value: Column) -> Column:
    """A preview that never holds the whole value."""
    last = F.right(value, F.lit(4))
    lead = F.when(value.rlike("^(?:AKIA|ASIA|gh)"), F.substring(value, 1, 4)).otherwise(F.substring(value, 1, 2))
    return F.when(value.startswith("sk-"), F.concat(F.lit("sk-****..."), last)).when(F.length(value) <= 8, F.lit("****")).otherwise(F.concat(lead, F.lit("****..."), last))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _masked_assignment(token: Column) -> Column:
    """A found assignment with its value masked; quotes stay."""
    head = F.regexp_extract(token, java(rf"\A(?i:{ASSIGNED})"), 0)

    def masked(x: Column) -> Column:
        def whole(value: Column) -> Column:
            def shown(mark: Column) -> Column:
                inner = F.when(mark != "", F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
                return F.concat(x, mark, bound(inner, mask_secret), mark)

            return bound(F.when(value.rlike(java(rf"\A(?:{DOUBLE}|{SINGLE})\Z")), F.substring(value, 1, 1)).otherwise(""), shown)

        return bound(F.substring(token, F.length(x) + 1, F.length(token)), whole)

    return bound(head, masked)


def _mask_assignments(text: Column) -> Column:
    """Every assignment is a token and masked by itself; what stands between stays. Two passes over the text.

    No split: it compiles its pattern anew for every row, which took most of the time of short texts.
    """

    def joined(t: Column) -> Column:
        rests, tokens = (F.regexp_extract_all(t, F.lit(java(f"(?i){TO_ASSIGNMENT}")), F.lit(k)) for k in (1, 2))
        whole = F.zip_with(rests, tokens, lambda rest, token: F.concat(rest, F.when(token == "", token).otherwise(_masked_assignment(token))))
        return F.array_join(whole, "")

    return bound(text, joined)


def show_controls(text: Column) -> Column:
    """Control and direction characters as \\uXXXX; line breaks and tabs stay."""

    def shown(t: Column) -> Column:
        letters = F.transform(F.split(t, ""), lambda c: F.when(c.rlike(CONTROLS), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c))
        # What is beyond plain ASCII is a simple class, so most texts pass one cheap test.
        return F.when(t.rlike(r"[^\t\n\r -~]") & t.rlike(CONTROLS), F.array_join(letters, "")).otherwise(t)

    return bound(text, shown)


def _holds(text: Column, *marks: str) -> Column:
    return reduce(Column.__or__, [text.contains(m) for m in marks])


def _step(text: Column, maybe: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    return bound(text, lambda x: F.when(maybe(x), change(x)).otherwise(x))


def _without_keys(text: Column) -> Column:
    return _step(text, lambda x: x.contains("PRIVATE KEY"), lambda x: F.regexp_replace(x, java(PRIVATE_KEY), "-----BEGIN $1-----\n[REDACTED PRIVATE KEY]"))


def _shapes(text: Column, login: str) -> Column:
    """Known shapes of keys, bearer tokens and logins masked; each pattern runs only where a text that its matches hold is there."""
    replaced = lambda pattern, by: lambda x: F.regexp_replace(x, pattern, by)
    t = _step(text, lambda x: x.contains("sk-"), replaced(java(API_KEY), "$1****...$2"))
    t = _step(t, lambda x: _holds(x, *GIT_MARKS), replaced(java(GIT_TOKEN), "$1****...$2"))
    t = _step(t, lambda x: _holds(x, "AKIA", "ASIA"), replaced(java(CLOUD_KEY), "$1****...$2"))
    t = _step(t, lambda x: F.lower(x).contains("bearer"), replaced(java(BEARER), "Bearer $1****...$2"))
    return _step(t, lambda x: x.contains("://"), replaced(login, "$1****@"))


def _masked_values(text: Column) -> Column:
    """Marked values as mask_secret shows them: what begins as a key, short ones, then all others."""
    x = F.regexp_replace(text, f"{OPEN}(?=sk-)[^{CLOSE}]*?([^{CLOSE}]{{1,4}}){CLOSE}", "sk-****...$1")
    x = F.regexp_replace(x, f"{OPEN}[^{CLOSE}]{{0,8}}{CLOSE}", "****")
    return F.regexp_replace(x, f"{OPEN}(AKIA|ASIA|gh[^{CLOSE}]{{2}}|[^{CLOSE}]{{2}})[^{CLOSE}]*([^{CLOSE}]{{4}}){CLOSE}", "$1****...$2")


def _redact_plain(text: Column) -> Column:
    """A plain text, or several with BETWEEN between them, without private keys.

    One pattern marks the values of all assignments, each quote outside its marks, and they are masked where they stand: a lambda for
    every text is interpreted, which took most of the time of short ones.
    """
    marked = F.regexp_replace(text, PLAIN_ASSIGNMENT, f"$1$2$4{OPEN}$3$5$6{CLOSE}$2$4")
    masked = _step(marked, lambda x: x.contains(OPEN), _masked_values)
    return _step(masked, lambda x: x.rlike(SHAPES), lambda x: _shapes(x, PLAIN_LOGIN))


def _redact_odd(text: Column) -> Column:
    """A text with characters beyond plain text."""
    assigned = lambda t: _step(_without_keys(t), lambda x: x.rlike(java(rf"(?i)(?=[ptsa])(?:{SECRET_WORDS})")), _mask_assignments)
    shaped = lambda t: _step(t, lambda x: bound(F.lower(x), lambda low: _holds(low, "sk-", *GIT_MARKS, "akia", "asia", "bearer", "://")), lambda x: _shapes(x, java(URL_LOGIN)))
    return show_controls(F.when(text.rlike(java(MAYBE_SECRET)), shaped(assigned(text))).otherwise(text))


def _suspect(text: Column) -> Column:
    """Whether redaction may change a text."""
    return text.rlike(SIGN) | text.rlike(UNPLAIN)


def redact_named(text: Column) -> Column:
    """redact_text of a column, which costs nothing to be named again; its tests stand in no lambda."""
    return F.when(_suspect(text), F.when(text.rlike(UNPLAIN), _redact_odd(text)).otherwise(_redact_plain(_without_keys(text)))).otherwise(text)


def redact_text(text: Column) -> Column:
    """Masks credentials: private keys, secret assignments, known key shapes, bearer tokens and logins in URLs.

    A text without any sign of a secret passes cheap tests only. Null stays null; redacting twice changes nothing.
    """
    return bound(text, redact_named)


def redact_data(value: Column, kind: DataType | str) -> Column:
    """Redacts all texts in a column of a type: strings, and those in arrays, maps (keys included) and structs, at any depth.

    The texts of an array are tested together and redacted together, those of structs field by field. The value is named often: a
    column, not something dear to compute.
    """
    match DataType.fromDDL(kind) if isinstance(kind, str) else kind:
        case StringType():
            return redact_named(value)
        case ArrayType(elementType=StringType()):
            # A private key may end in another text.
            whole = F.array_join(value, "\n")
            return F.when(_suspect(whole), F.when(whole.rlike(UNPLAIN) | whole.contains("PRIVATE KEY"), F.transform(value, redact_text)).otherwise(_redact_together(value))).otherwise(value)
        case ArrayType(elementType=StructType(fields=fields) as inner) if "string" in inner.simpleString():
            tested = [f for f in fields if isinstance(f.dataType, StringType) or f.dataType in (ArrayType(StringType(), True), ArrayType(StringType(), False))]
            apart = F.transform(value, lambda v: F.when(v.isNotNull(), F.struct(*[redact_data(v[f.name], f.dataType).alias(f.name) for f in fields])))
            if len(tested) < sum("string" in f.dataType.simpleString() for f in fields):
                return apart
            # The tests of all fields stand in no lambda; a null that may hide texts is no plain text.
            whole = F.concat_ws("\n", *[_texts_of(value, f) for f in tested])
            return F.when(_suspect(whole), F.when(whole.rlike(UNPLAIN) | whole.contains("PRIVATE KEY"), apart).otherwise(_redact_plain_fields(value, fields, tested))).otherwise(value)
        case ArrayType(elementType=inner) if "string" in inner.simpleString():
            return F.transform(value, lambda v: redact_data(v, inner))
        case MapType(keyType=keys, valueType=values):
            return F.transform_values(F.transform_keys(value, lambda k, _: redact_data(k, keys)), lambda _, v: redact_data(v, values))
        case StructType(fields=fields):
            return F.when(value.isNotNull(), F.struct(*[redact_data(value[f.name], f.dataType).alias(f.name) for f in fields]))
    return value


def _texts_of(value: Column, field: StructField) -> Column:
    """The texts of a field of an array's structs, which is a text or an array of them."""
    return value[field.name] if isinstance(field.dataType, StringType) else F.coalesce(F.flatten(value[field.name]), F.array(F.lit("\0")))


def _redact_plain_fields(value: Column, fields: list[StructField], tested: list[StructField]) -> Column:
    """An array of structs whose texts are plain and hold no private key: a field without a sign of a secret stays, a field of texts
    is redacted together, and a field of arrays array by array."""
    names = {f.name: f"t{k}" for k, f in enumerate(tested)}
    texts = [f.name for f in tested if isinstance(f.dataType, StringType)]
    flags = F.struct(*[F.concat_ws("\n", _texts_of(value, f)).rlike(SIGN).alias(names[f.name]) for f in tested])

    def rebuilt(flags: Column, done: Column) -> Column:
        def field(v: Column, i: Column, f: StructField) -> Column:
            if f not in tested:
                return v[f.name]
            return F.when(flags[names[f.name]], F.get(done[names[f.name]], i) if f.name in texts else _redact_together(v[f.name])).otherwise(v[f.name])

        return F.transform(value, lambda v, i: F.when(v.isNotNull(), F.struct(*[field(v, i, f).alias(f.name) for f in fields])))

    together = lambda flags: F.struct(*[F.when(flags[names[n]], _redact_together(value[n])).alias(names[n]) for n in texts])
    return bound(flags, lambda flags: bound(together(flags), lambda done: rebuilt(flags, done)) if texts else rebuilt(flags, flags))


def _redact_together(texts: Column) -> Column:
    """Plain texts of an array, joined, redacted once and split again; with a null among them each is redacted by itself."""
    parts = F.split(_redact_plain(F.array_join(texts, BETWEEN)), BETWEEN, -1)
    return bound(parts, lambda x: F.when(F.size(x) == F.size(texts), x).otherwise(F.transform(texts, _redact_plain)))


def snippet(line: Column) -> Column:
    """Evidence text: stripped, redacted, then cut to 500 characters."""
    return F.substring(redact_text(strip(line)), 1, 500)
