"""Secret scan: patterns, plus an assignment-aware lexer.

The lexer reads source and configuration syntax as pairs of a name and an expression: `name = "x"`, `name: x`,
`"name": "x"`, `name := "x"`, `export NAME=x`, `name => "x"`, where the expression is a chain of quoted literals,
bare words and names joined by `+` or `.`; between bare words without blanks `+` is a character of the word unless
a name stands beside it.  Names used in an expression stand for all literals that were ever
assigned to them, directly or through other names (constant propagation).  A literal is scored by the sensitive
words in the name it ends up in and by its own look; from THRESHOLD on it is a finding: kind `literal` where it is
assigned directly, kind `constant` where it came through names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from bourse.llm.common import col, pieces

THRESHOLD = 0.5
KINDS = ("assign", "access", "hex", "literal", "constant")

#: fixed values: the patterns every scan reports; the least length is that of group 2, or of the match
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: words of a name and how much they say; a name scores its best word or pair of words
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0}
KEY_OF = {"api", "access", "secret", "private", "signing", "encryption", "client", "auth", "master", "account"}
#: last words of names that describe a secret instead of holding one
ABOUT = {"id", "name", "url", "uri", "path", "file", "count", "max", "min", "length", "size", "type", "expires", "ttl", "limit", "field", "header"}
HOLLOW = re.compile(r"(?i)(.)\1*|change.?me|example.*|your.*|todo|none|null|true|false|test|dummy|placeholder|\$\{.*|\$\(.*|<.*>|%.*%|\{\{.*")

SIGN = re.compile(r"(?<![=!<>:+*/|&^%~-])(?::=(?!=)|=>(?!=)|=(?!=)|:(?![:=]|//))")
FIRST = re.compile(r"[A-Za-z_$]")
#: a character of a bare word; '+' stands within or before a word, and behind it where no other term follows
WORD = r"""[^\s"'`,;#(){}\[\]+]"""
#: a term: a PEM block, also over several lines and as a YAML block; a literal in quotes; a bare word
TERM = re.compile(r"""[ \t]*(?:(?:[|>][+-]?[ \t]*\r?\n[ \t]*)?["'`]{0,3}(-----BEGIN[ ][A-Z0-9 ]+-----(?:(?!-----)[^"'`])+-----END[ ][A-Z0-9 ]+-----)(?:\\[nr]|\s)*["'`]{0,3}
    |"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`|(\+*{W}+(?:\++{W}+)*(?:\++(?=[ \t]*(?:[\r\n,;#)}\]]|\Z)))?))""".replace("{W}", WORD), re.VERBOSE)
JOIN = re.compile(r"""[ \t]*(?:\+|\.(?=[ \t]*["'`]))[ \t]*""")
#: literals that hold a secret for all their blanks and '://': PEM blocks, URLs with user:password@, values of an Authorization header
CERTAIN = re.compile(r"\A\s*-----BEGIN |\A(?:Bearer|Basic) +\S+\Z|://[^\s/:@]*:[^\s/@]+@")
#: what a blank or '://' leaves of the look of other literals; a name that scores 0.8 or more can still reach THRESHOLD
DAMPED = 0.65
PLUSSED = re.compile(r"[^+]+")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int]


def name_score(name: str) -> float:
    words = [w.lower() for w in PART.findall(name)]
    if not words or words[-1] in ABOUT or words[0] in ("max", "min", "num", "n"):
        return 0.0
    best = max(SENSITIVE.get(w, 0.0) for w in words)
    for a, b in zip(words, words[1:], strict=False):
        best = max(best, SENSITIVE.get(a + b, 0.0), 0.9 if b == "key" and a in KEY_OF else 0.0)
    return best


def literal_score(value: str) -> float:
    """1 for what looks random, less for words, blanks and placeholders."""
    if len(value) < 6 or HOLLOW.fullmatch(value):
        return 0.0
    seen, n = Counter(value), len(value)
    bits = -sum(c / n * math.log2(c / n) for c in seen.values())
    look = min(1.0, bits / 3.0)
    if (" " in value or "://" in value) and not CERTAIN.search(value):
        look *= DAMPED
    return look


def name_before(text: str, end: int) -> str | None:
    """The name before a sign, blanks and closing quotes aside; no sign is passed, so all walks together are linear."""
    if end and text[end - 1] == "\n":
        end -= 1
    while end and text[end - 1] in " \t":
        end -= 1
    for _ in range(2):
        if end and text[end - 1] in "\"'`]":
            end -= 1
    start = end
    while start and ((c := text[start - 1]).isalnum() or c in "_$.-"):
        start -= 1
    first = FIRST.search(text, start, end)
    return text[first.start():end] if first else None


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """(name, terms) of every assignment; a term is (start, end, quoted)."""
    for sign in SIGN.finditer(text):
        name = name_before(text, sign.start())
        if not name:
            continue
        terms, at = [], sign.end()
        while term := TERM.match(text, at):
            group = term.lastindex
            terms.append((*term.span(group), group < 5))
            at = term.end()
            if not (more := JOIN.match(text, at)):
                break
            at = more.end()
        if terms:
            yield name, terms


def opened(text: str, terms: list[tuple[int, int, bool]], assigned: dict[str, list[int]]) -> Iterator[tuple[int, int, bool]]:
    """The terms, bare words cut at every '+' that stands beside an assigned name."""
    for start, end, quoted in terms:
        if quoted or "+" not in text[start:end]:
            yield start, end, quoted
            continue
        at, last, after_name = start, start, False
        for part in PLUSSED.finditer(text, start, end):
            name = part[0] in assigned
            if name or after_name:
                if last > at:
                    yield at, last, False
                at = part.start()
            last, after_name = part.end(), name
        yield at, last if after_name else end, False


def reached(uses: list[set[str]], weights: list[float], assigned: dict[str, list[int]]) -> list[float]:
    """The highest weight of a name that each assignment's value ends up in through other names; 0 for none.

    Names are gone through by falling weight, so every assignment and every name is opened once, by the
    highest weight that gets there: work in proportion to the text, whatever its assignments look like.
    """
    out, opened_, passed = [0.0] * len(uses), [False] * len(uses), set()
    for i in sorted(range(len(uses)), key=lambda i: -weights[i]):
        weight, todo = weights[i], [i]
        if not weight:
            break
        while todo:
            j = todo.pop()
            if opened_[j]:
                continue
            opened_[j] = True
            for name in uses[j] - passed:
                passed.add(name)
                for k in assigned[name]:
                    out[k] = weight
                    todo.append(k)
    return out


def lexed(text: str) -> set[Span]:
    """Findings of the lexer."""
    if "=" not in text and ":" not in text:
        return set()
    found = list(pairs(text))
    assigned: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(found):
        assigned.setdefault(name, []).append(i)
    found = [(name, list(opened(text, terms, assigned))) for name, terms in found]
    uses = [{text[a:b] for a, b, quoted in terms if not quoted} & assigned.keys() for _, terms in found]
    direct = [name_score(name) for name, _ in found]
    out: set[Span] = set()
    for (_, terms), own, carried in zip(found, direct, reached(uses, direct, assigned), strict=True):
        if not own and not carried:
            continue
        for start, end, quoted in terms:
            value = text[start:end]
            # a bare word is a literal only if it can't be a name and has a digit
            if not quoted and (value in assigned or not any(c.isdigit() for c in value)):
                continue
            look = literal_score(value)
            if own * look >= THRESHOLD:
                out.add(("literal", start, end))
            elif carried * look >= THRESHOLD:
                out.add(("constant", start, end))
    return out


def base(text: str) -> list[Span]:
    """The patterns' findings, leftmost and not overlapping within a kind; start and end of the whole match."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def written(spans: list[Span]) -> str:
    """kind:start:end by start, then kind, joined by commas"""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed) for every row of `docs`.

    Positions count code points, ends are exclusive.  NULL and empty texts have no
    spans.  A NULL id stays NULL, repeated rows give repeated results, other columns
    are ignored.  One narrow pass, no shuffle.
    """
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for text in b.column(1).to_pylist():
                found = base(text) if text else []
                more = lexed(text) if text else set()
                n = Counter(s[0] for s in found)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(written(found).encode()).hexdigest(),
                             written([*found, *more]), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                             ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lexed bigint"
    ).withColumnRenamed("id", id_col)
