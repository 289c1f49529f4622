"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns and always stay. The model adds what the patterns
miss: telephone numbers without a country code, spelt-out addresses ("name at mail dot
com"), grouped card numbers and addresses of machines in a clear context. It looks at
zones, the stretches of words around digits, "@" or a spelt-out dot, cut into atoms
(digit runs, letter runs, single signs, white space). A segmentation of a zone is a
sequence of segments, each a single outside atom or an entity of one kind of at most
SEGMENT_ATOMS atoms, and is scored by features of whole spans: digit counts, grouping,
check digits, value ranges, brackets, what stands before and after. The forward
recursion gives the likelihood that weights are trained on, and the same dynamic
programme with max in place of sum picks boundaries and kinds together; both are linear
in a zone's atoms. Atoms of base spans are closed to entities of the model.

No labelled spans exist in the data, so weights are trained on TRAIN_SENTENCES sentences
that a seeded generator writes, with their spans, and with what looks like personal data
but is not: dates, versions, prices, order numbers, keys.

Bounds of the model, which base spans do not have: an entity has SEGMENT_ATOMS atoms at
most, a spelt-out address ADDRESS_CHARS characters (the longest that mail allows), and a
hint stands within CONTEXT_CHARS characters in front of a zone.

Defined cases. Null or empty text: no spans. Null doc_id: kept as null. Repeated rows:
each on its own. Long texts: read whole. Empty table: no rows. `found` and `redact`
carry other columns along, whatever their names; columns of docs that are named like the
two that `found` adds give way to them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from millrace.llm.common import numbered, place_of, steps, without

KINDS = ("email", "ip", "card", "phone")
#: Atoms of an entity at most.
SEGMENT_ATOMS = 24
#: Sentences that the weights are trained on, passes over them, and the step.
TRAIN_SENTENCES, PASSES, STEP, RIDGE = 500, 6, 0.2, 1e-4
#: Words in front of a span that count as its context, and how far in front of a zone they are looked for.
CONTEXT_WORDS, CONTEXT_CHARS = 2, 40
#: Characters of a spelt-out address at most.
ADDRESS_CHARS = 254

# The base patterns, fixed by the contract of the query.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Digit runs are taken whole: a start inside a run can match no more than its beginning.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Pattern matches of every kind, leftmost and non-overlapping within a kind; by kind, then start."""
    out: list[Span] = []
    ended, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > ended and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", first, m.end()))
            ended = m.end()
        at = text.find("@", max(at + 1, ended))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_DIGIT = re.compile("[0-9]")
_ANCHOR = re.compile(r"[0-9@]|(?i:(?<=[\s\[({])dot(?=[\s\])}]))")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.DOTALL)
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+(?:\s?@\s?|\s*(?:\(at\)|\[at\]|\{at\})\s*|\s+at\s+)[A-Za-z0-9-]+(?:(?:\.|\s*(?:\(dot\)|\[dot\]|\{dot\})\s*|\s+dot\s+)[A-Za-z0-9-]+)+", re.I)
#: What a word before a span hints at.
HINTS = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "telefono", "teléfono", "téléphone", "handy"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"),
    "ip": ("ip", "host", "server", "address", "addr", "node"),
    "email": ("mail", "email", "contact", "write", "correo"),
    "other": ("order", "invoice", "no", "nr", "id", "version", "v", "page", "year", "price", "usd", "eur", "license", "key", "token", "password", "part", "serial", "isbn", "item"),
}
#: Words that name no mail host, however an address is spelt out.
LITTLE = frozenset(("the", "a", "an", "this", "that", "one", "each", "every"))
_HINT = {w: k for k, words in HINTS.items() for w in words}


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of neighbouring words that hold an anchor; a spelt-out dot brings three words before it and one after, a lone @ one of each."""
    out: list[tuple[int, int]] = []
    n = len(text)
    for m in _ANCHOR.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        a, b = m.start(), m.end()
        alone = m[0] == "@" and (not a or text[a - 1].isspace())
        words = 3 if m[0].lower() == "dot" else int(alone)
        floor = out[-1][1] if out else 0
        for i in range(words + 1):
            while a > floor and text[a - 1].isspace() and i:
                a -= 1
            while a > floor and not text[a - 1].isspace():
                a -= 1
        for i in range(bool(words) + 1):
            while b < n and text[b].isspace() and i:
                b += 1
            while b < n and not text[b].isspace():
                b += 1
        if out and a - out[-1][1] <= 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _kinds_of(s: str) -> Iterator[str]:
    """The kinds that a span may be at all."""
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        return
    letters = any("a" <= c <= "z" or "A" <= c <= "Z" for c in s)
    if letters:
        if len(s) <= ADDRESS_CHARS and ("@" in s or "at" in s.lower()) and _SPELT.fullmatch(s):
            yield "email"
        return
    if not s.isascii():
        return
    d = len(_digits(s))
    if s.count(".") == 3 and d == len(s) - 3:
        yield "ip"
    if 13 <= d <= 19 and all(c.isdigit() or c in " -" for c in s):
        yield "card"
    if 7 <= d <= 15 and s[-1].isdigit() and all(c.isdigit() or c in "+ ().-/" for c in s) and "+" not in s[1:]:
        yield "phone"


def _features(kind: str, s: str, before: str, after: str, hint: str) -> list[str]:
    """Of a whole span, with the sign before it, the one after it and the hint of its context."""
    d = _digits(s)
    groups = [len(x) for x in re.split("[^0-9]+", s) if x]
    out = ["bias", f"hint={hint}", f"glued={before.isalnum() or before in '.-_/#$€=' and before != ''}", f"runs on={after.isalnum() or after in '%' and after != ''}"]
    if kind == "email":
        out += [f"little={not LITTLE.isdisjoint(re.findall('[a-z]+', s.lower())[1:-1])}", f"sign={'@' in s}", f"brackets={any(c in s for c in '([{')}", f"top={2 <= len(re.split('[^A-Za-z0-9-]+', s)[-1]) <= 6}"]
    elif kind == "ip":
        parts = s.split(".")
        out += [f"range={all(x and len(x) <= 3 and int(x) <= 255 for x in parts)}", f"wide={sum(len(x) for x in parts) >= 7}"]
    elif kind == "card":
        out += [f"digits={len(d)}", f"check={luhn(d)}", f"fours={groups[:3] == [4, 4, 4]}", f"one={len(groups) == 1}", f"lead={d[0] in '3456'}"]
    else:
        year = groups[0] == 4 and d[:2] in ("19", "20") or groups[-1] == 4 and len(groups) == 3 and max(groups[:2]) <= 2
        out += [f"digits={len(d)}", f"groups={'-'.join(map(str, groups[:5]))}", f"plus={s[0] == '+'}", f"brackets={'(' in s and ')' in s}", f"date={year}", f"one={len(groups) == 1}", f"dots={'.' in s}"]
    return [f"{kind}:{f}" for f in out]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that may overlap, as disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shut_atoms(borders: list[int], closed: list[tuple[int, int]], at: int = 0) -> list[bool]:
    """Whether each atom meets one of the disjoint sorted spans closed[at:], in one pass over both."""
    out = []
    for a, b in zip(borders, borders[1:], strict=False):
        while at < len(closed) and closed[at][1] <= a:
            at += 1
        out.append(at < len(closed) and closed[at][0] < b)
    return out


def lattice(text: str, a: int, b: int, closed: list[tuple[int, int]], at: int = 0) -> tuple[list[int], list[tuple[int, int, str, list[str]]]]:
    """Atom borders of a zone and its segments (from atom, to atom, kind or "", features); closed[at:] are disjoint and sorted."""
    borders = [m.start() for m in _ATOM.finditer(text, a, b)] + [b]
    edges: list[tuple[int, int, str, list[str]]] = []
    shut = shut_atoms(borders, closed, at)
    seen = re.findall(r"\w+", text[max(0, a - CONTEXT_CHARS) : a])
    for i in range(len(borders) - 1):
        piece = text[borders[i] : borders[i + 1]]
        shape = "digits" if piece[0].isdigit() else "letters" if piece.isalpha() else "space" if piece.isspace() else "sign"
        edges.append((i, i + 1, "", [f"out:{shape}"]))
        if not shut[i] and shape != "space":
            hint = next((_HINT[w.lower()] for w in reversed(seen[-CONTEXT_WORDS:]) if w.lower() in _HINT), "none")
            for j in range(i + 1, min(i + SEGMENT_ATOMS, len(borders) - 1) + 1):
                if shut[j - 1]:
                    break
                s = text[borders[i] : borders[j]]
                for kind in _kinds_of(s):
                    edges.append((i, j, kind, _features(kind, s, text[borders[i] - 1 : borders[i]], text[borders[j] : borders[j] + 1], hint)))
        if shape in ("letters", "digits"):
            seen.append(piece)
    return borders, edges


Weights = dict[str, float]


def decode(n: int, edges: list[tuple[int, int, str, list[str]]], w: Weights) -> list[tuple[int, int, str]]:
    """Entities of the best segmentation; edges come ordered by their first atom."""
    best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
    for i, j, kind, fs in edges:
        value = best[i] + sum(w.get(f, 0.0) for f in fs)
        if value > best[j]:
            best[j], back[j] = value, (i, kind)
    out, at = [], n
    while at:
        i, kind = back[at]
        if kind:
            out.append((i, at, kind))
        at = i
    return out[::-1]


def _sum(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low - high < -60 else high + log(1.0 + exp(low - high))


def _improve(n: int, edges: list[tuple[int, int, str, list[str]]], truth: set[tuple[int, int, str]], w: Weights) -> None:
    """One step up the log-likelihood of the true segmentation."""
    score = [sum(w.get(f, 0.0) for f in e[3]) for e in edges]
    ahead, behind = [0.0] + [-1e300] * n, [-1e300] * n + [0.0]
    for (i, j, _, _), s in zip(edges, score, strict=True):
        ahead[j] = _sum(ahead[j], ahead[i] + s)
    for (i, j, _, _), s in zip(reversed(edges), reversed(score), strict=True):
        behind[i] = _sum(behind[i], behind[j] + s)
    inside = {x for i, j, _ in truth for x in range(i, j)}
    for (i, j, kind, fs), s in zip(edges, score, strict=True):
        target = float((i, j, kind) in truth if kind else i not in inside)
        gain = target - exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))
        if gain:
            for f in fs:
                w[f] = w.get(f, 0.0) * (1 - RIDGE) + STEP * gain


def sentences(n: int, seed: int = 11) -> Iterator[tuple[str, list[Span]]]:
    """Texts with their spans."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{num(2)} {num(3)} {num(7)}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"0{num(3)} {num(6)}", f"00{num(2)} {num(3)} {num(6)}"])

    def email() -> str:
        user, host, top = word() + r.choice(["", ".", "_"]) + r.choice([word(), num(2)]), word(), r.choice(["com", "org", "net", "de", "fr", "es"])
        return r.choice([f"{user}@{host}.{top}", f"{user} at {host} dot {top}", f"{user} (at) {host} (dot) {top}", f"{user}[at]{host}[dot]{top}", f"{user} @ {host}.{top}"])

    def ip() -> str:
        return ".".join(str(r.randint(1, 255)) for _ in range(4))

    def other() -> str:
        return r.choice(
            [
                f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2030)}", f"version {r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{num(2)}.{num(3)}", f"${r.randint(1, 999)},{num(3)}.{num(2)}", f"order {num(r.randint(5, 12))}",
                f"invoice no {num(8)}", f"id {num(r.randint(7, 16))}", num(r.randint(1, 20)), f"pages {num(2)}-{num(3)}", f"isbn 978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", f"key {word()}{num(5)}{word()}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}.{num(2)}%", f"{word()} at {word()}", f"the dot {word()} {num(3)}", f"{word()} at {r.choice(sorted(LITTLE))} dot {r.choice(['com', word()])}", f"part {num(3)}-{num(4)}", f"{num(3)} {num(3)}", f"password={num(4)}{word()}{num(7)}", f"300.{num(3)}.999.{num(2)}",
            ]
        )

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                hinted = r.random() < 0.3
                if hinted:
                    text += r.choice(HINTS[kind]) + r.choice([" ", ": "])
                # A bare row of digits is a telephone number only where a word says so.
                made = num(r.randint(9, 11)) if hinted and kind == "phone" and r.random() < 0.4 else makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += other()
            text += r.choice([" ", ", ", ". "])
        yield text, spans


@lru_cache(maxsize=1)
def weights() -> Weights:
    """Trained once a driver; a few hundred numbers."""
    w: Weights = {}
    made = []
    for text, spans in sentences(TRAIN_SENTENCES):
        for a, b in zones(text):
            borders, edges = lattice(text, a, b, [])
            place = {x: i for i, x in enumerate(borders)}
            truth = {(place[x], place[y], k) for k, x, y in spans if x in place and y in place}
            made.append((len(borders) - 1, edges, truth & {e[:3] for e in edges}))
    for _ in range(PASSES):
        for n, edges, truth in made:
            _improve(n, edges, truth, w)
    return w


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the model's; each by kind, then start."""
    base = base_spans(text)
    more = list(base)
    closed = united(sorted((a, b) for _, a, b in base))
    at = 0
    for a, b in zones(text):
        while at < len(closed) and closed[at][1] <= a:
            at += 1
        borders, edges = lattice(text, a, b, closed, at)
        if any(e[2] for e in edges):
            more += [(kind, borders[i], borders[j]) for i, j, kind in decode(len(borders) - 1, edges, w)]
    return base, sorted(more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def found(docs: DataFrame) -> DataFrame:
    """docs with _pii_base and _pii_all: arrays of (kind, start, end) in code points."""
    w = weights()
    docs = without(docs, "_pii_base", "_pii_all")
    plain, place = numbered(docs), place_of(docs, "text")
    names = [*plain.columns, "base", "every"]
    schema = StructType([*plain.schema.fields, StructField("base", _SPAN), StructField("every", _SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, place):
            pairs = [all_spans(t or "", w) for t in batch.column(place).to_pylist()]
            both = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in p[i]] for p in pairs], type=kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], names=names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, "_pii_base", "_pii_all")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced; n_chars, where there is such a column, follows the text."""
    w = weights()
    plain, place, sized = numbered(docs), place_of(docs, "text"), place_of(docs, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, place):
            texts = [None if t is None else redacted(t, all_spans(t, w)[1]) for t in batch.column(place).to_pylist()]
            batch = batch.set_column(place, f"c{place}", pa.array(texts, type=batch.schema.field(place).type))
            if sized is not None:
                old = batch.column(sized)
                batch = batch.set_column(sized, f"c{sized}", pa.array([o if t is None else len(t) for t, o in zip(texts, old.to_pylist(), strict=True)], type=old.type))
            yield batch

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    marked = found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def line(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def is_kind(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("_pii_base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return marked.select("doc_id", *counts, F.sha2(line("_pii_base").cast("binary"), 256).alias("base_sha256"), line("_pii_all").alias("spans"))


def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """The base spans of op3_pii by kind, which SQL can count."""
    return op3_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS])


BASE_COUNTS_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
         [regexp_replace(s, '[^0-9]', '', 'g') FOR s IN regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')] AS cards,
         [regexp_replace(s, '[^0-9]', '', 'g') FOR s IN regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')] AS phones
  FROM docs)
SELECT doc_id, CAST(len(emails) AS BIGINT) AS n_email,
       CAST(len([s FOR s IN ips IF len([p FOR p IN string_split(s, '.') IF len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS HUGEINT), 0) > 255]) = 0]) AS BIGINT) AS n_ip,
       CAST(len([d FOR d IN cards IF len(d) BETWEEN 16 AND 19
                 AND list_sum([CASE WHEN k % 2 = 0 THEN CAST(d[len(d) - k] AS INTEGER) ELSE 2 * CAST(d[len(d) - k] AS INTEGER) - CASE WHEN CAST(d[len(d) - k] AS INTEGER) > 4 THEN 9 ELSE 0 END END FOR k IN range(len(d))]) % 10 = 0]) AS BIGINT) AS n_card,
       CAST(len([d FOR d IN phones IF len(d) BETWEEN 8 AND 15]) AS BIGINT) AS n_phone
FROM found
"""
