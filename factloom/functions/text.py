"""Text functions as columns: normalisation, hashing, stable JSON, clipping; NFKC needs Python."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript's \s matches beyond ASCII, and legal forms that company names lose.
JS_SPACE = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
LEGAL_FORMS = r"株式会社|有限会社|合同会社|inc\.?|ltd\.?|corp\.?"


def js(pattern: str, ignore_case: bool = True) -> str:
    """A pattern for Java's engine with JavaScript's ASCII word boundaries and wide white space."""
    word = "A-Za-z0-9_"
    bound = f"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out.append({"\\s": JS_SPACE if inside else f"[{JS_SPACE}]", "\\b": two if inside else bound}.get(two, two))
            i += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(two[0])
        i += 1
    cased = any(c.lower() != c.upper() for c in pattern if not c.isascii())  # the wide form costs time, and only they need it
    return ("(?iu)" if cased else "(?i)" if ignore_case else "") + "".join(out)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(js(pattern)), F.lit(False))


def literals(pattern: str) -> tuple[str, ...]:
    """The longest plain run of each alternative of a pattern, folded: no text without one of them matches. Empty if an alternative has none."""
    runs, depth, i = [[""]], 0, 0
    while i < len(pattern):
        c, step, plain = pattern[i], 1, False
        if c == "\\":
            step = 2
        elif c == "[":
            step = pattern.index("]", i + 2) - i + 1
        elif c == "{":
            step = pattern.index("}", i) - i + 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            runs.append([])
        else:
            plain = not depth and c not in ".^$*?+|"
        if c in "*?{" and not depth:
            runs[-1][-1] = runs[-1][-1][:-1]  # what may be absent is no part of the run
        if plain:
            runs[-1][-1] += c
        else:
            runs[-1].append("")
        i += step
    longest = [max(r, key=len) for r in runs]
    return tuple(dict.fromkeys(x.upper().lower() for x in longest)) if all(longest) else ()


def folded(text: Column) -> Column:
    """Text in which `literals` stand as plain parts, whatever the case that a pattern accepts."""
    return F.lower(F.upper(text))


def likely(folded_text: Column, pattern: str) -> Column:
    """Whether a text may match, by plain searches, which cost far less than the pattern."""
    return reduce(or_, [F.contains(folded_text, F.lit(x)) for x in literals(pattern)] or [F.lit(True)])


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII needs none, so plain columns stay fast by `ascii_nfkc`."""
    return _nfkc(text)


def _normalise(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def _nfkc(text: Column) -> Column:
    return F.pandas_udf(_normalise, "string")(text)


def company_name(text: Column, compose: bool = True) -> Column:
    """Letters and digits of a company's name in lower case, without its legal form."""
    t = F.lower(nfkc(text) if compose else text)
    return F.regexp_replace(F.regexp_replace(t, f"(?i){LEGAL_FORMS}", ""), r"[^\p{L}\p{N}]+", "")


def directory_name(text: Column, compose: bool = True) -> Column:
    """The directory's way: no white space, lower case, legal form kept."""
    return F.lower(F.regexp_replace(nfkc(text) if compose else text, f"[{JS_SPACE}]+", ""))


def ascii_name(text: Column) -> Column:
    """The SQL way: ASCII letters and digits in lower case."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def weak_text(text: Column, compose: bool = True) -> Column:
    t = F.lower(nfkc(text) if compose else text)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def weak_cluster_key(company: Column, title: Column, location: Column, compose: bool = True) -> Column:
    return F.sha2(F.concat_ws("\x00", company_name(company, compose), weak_text(title, compose), weak_text(location, compose)), 256)


def strong_key(family: Column, tenant: Column, posting: Column, detail_url: Column, official_url: Column) -> Column:
    """Identity by official URL, else by posting, else by detail URL."""
    external = F.when(tenant.isNotNull() & posting.isNotNull(), F.concat(F.lit("external:"), family, F.lit(":"), tenant, F.lit(":"), posting))
    return F.coalesce(F.concat(F.lit("official:"), official_url), external, F.concat(F.lit("detail:"), detail_url))


def clean_text(text: Column) -> Column:
    """Plain spaces, none around line ends, at most one empty line, none at the ends."""
    t = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"[ \t\f\x0b]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\r?\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def canonical_html(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def raw_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def content_hash(version: Column, canonical: Column) -> Column:
    """SHA-256 of the version, a zero byte, and the canonical bytes."""
    return F.sha2(F.concat(F.encode(version, "UTF-8"), F.unhex(F.lit("00")), F.encode(canonical, "UTF-8")), 256)


def idempotency_key(kind: Column, **parts: Column) -> Column:
    inner = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), inner.alias("parts"))), 256)


def run_key(version: Column, inputs: Column) -> Column:
    """inputs: array of structs (id, score); order does not matter."""
    return F.sha2(F.to_json(F.struct(version.alias("version"), F.array_sort(inputs).alias("inputs"))), 256)


def concise_quote(text: Column, most: int = 500) -> Column:
    return F.substring(F.trim(text), 1, most)


def includes_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def company_from_title(title: Column, label: str = "") -> Column:
    """The part after the last slash, without a leading label."""
    last = F.trim(F.element_at(F.split(title, "[/／]"), -1))
    return F.trim(F.regexp_replace(last, f"^(?:{label})[:：]?", "")) if label else last


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def embedding_text(title: Column, company: Column, description: Column, most: int = 8000) -> Column:
    return F.to_json(F.struct(title.alias("title"), company.alias("company"), F.substring(description, 1, most).alias("description")))


def finite_vector(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
