"""Personal data in texts: fixed rules, and candidates that boosted trees accept by format and context.

Rules find what is certain. Generators propose more, loosely and overlapping: addresses spelled out,
numbers without their plus sign, spaced digits. Trees are fitted on the proposals of all documents, labelled
by whether a rule accepts them, and do not see the sign that the rule goes by: two thirds of the documents, by
the hash of the row, fit the trees, and the others, unseen, calibrate a threshold per kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.boosting import BINS, Boosted
from rinkspark.llm.common import shared_value, slices, staged, text_of

KINDS = ("email", "ip", "card", "phone")
#: One document in so many calibrates; probabilities are compared in steps of 1 / ``GRID``.
FOLDS, GRID = 3, 10_000
#: What a staged span is: accepted by a rule, apart from all the rules' spans. Documents handed on at a time.
ACCEPTED, APART, HANDED = 1, 2, 1000
#: Share of unseen proposals over a threshold that the rules confirm, and the fewest that can show it.
PRECISION, SUPPORT = 0.9, 15
#: A country code in front of a number.
PREFIX = re.compile(r"(?:\+|00)[0-9]{0,3}[\x20.-]?$")
Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Proposals, looser than the rules.
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[(\[{]\s?at\s?[)\]}]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\sdot\s)\s?[A-Za-z0-9-]{2,24}){1,4}"
)
SPELLED_SIGN = re.compile(r"[(\[{]\s?(?:at|dot)\s?[)\]}]|\sdot\s|\s@|@\s")
SPACED_FOUR = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}(?![0-9.])")
LOOSE_CHAIN = re.compile(r"(?<![0-9])[0-9]{2,6}(?:[\x20._-]{1,2}[0-9]{2,6}){2,6}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9])")
#: Context words, in the languages of the corpus (fixed values).
CUES = (("mail", "email", "e-mail", "correo", "courriel"), ("ip", "host", "server", "address", "addr"),
        ("card", "visa", "karte", "carte", "tarjeta"), ("tel", "phone", "call", "fax", "telefon", "mobile", "fono"))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at-signs: no other character can stand in for one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The fixed rules, leftmost and not overlapping within a kind; failing matches are dropped."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in FOUR.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PLUS.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def proposals(text: str) -> list[Span]:
    """High recall: whatever might be personal data, overlaps included."""
    found = []
    if "@" in text or SPELLED_SIGN.search(text):
        anchors = [m.start() for m in SPELLED_SIGN.finditer(text)] + [m.start() for m in re.finditer("@", text)]
        for at in anchors:  # only near a sign, so that plain prose costs nothing
            low = max(0, at - 80)
            for m in SPELLED.finditer(text, low, min(len(text), at + 160)):
                if m.start() <= at <= m.end():
                    found.append((0, m.start(), m.end()))
    found += [(1, m.start(), m.end()) for m in SPACED_FOUR.finditer(text)]
    for m in LOOSE_CHAIN.finditer(text):
        if 13 <= len(digits_of(m.group())) <= 19:
            found.append((2, m.start(), m.end()))
    found += [(2, m.start(), m.end()) for m in CHAIN.finditer(text) if 13 <= len(digits_of(m.group())) <= 19]
    found += [(3, m.start(), m.end()) for m in LOOSE_PHONE.finditer(text) if 7 <= len(digits_of(m.group())) <= 15]
    return sorted(set(found), key=lambda s: (s[1], s[0], s[2]))


def features(text: str, span: Span) -> list[float]:
    """Format and context. A country code in front is left out: its plus sign is what the phone rule goes by."""
    kind, start, end = span
    body = text[start:end]
    groups = re.findall(r"[0-9]+", body)
    before = PREFIX.sub("", text[max(0, start - 24) : start])
    after = text[end : end + 12]
    low = before.lower()
    digits = "".join(groups)
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        float(len(body)),
        float(len(digits)),
        float(sum(c.isalpha() for c in body)),
        float(len(groups)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(len({len(g) for g in groups})),
        float(body.count(".")),
        float(body.count("-")),
        float(body.count(" ")),
        float(body.count("(") + body.count("[")),
        float(body.count("@")),
        float(digits[:1] == "4"),
        float(kind == 2 and luhn(digits)),
        float(max((int(g[:6]) for g in groups), default=0) if kind == 1 else 0),
        float(before[-1:].isalnum()),
        float(before[-1:] in "=\"'#/_"),
        float(after[:1].isalnum()),
        float(after[:1] in "\"'/_%"),
        float(sum(c.isdigit() for c in before)),
        float(sum(c.isdigit() for c in after)),
        *[float(any(cue in low for cue in cues)) for cues in CUES],
    ]


def apart(spans: list[Span], taken: list[tuple[int, int]]) -> list[bool]:
    """Which spans overlap none of ``taken``."""
    ends: list[tuple[int, int]] = []
    for a, b in sorted(taken):
        if ends and a < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    starts = [a for a, _ in ends]
    found = []
    for _, a, b in spans:
        at = bisect_left(starts, b) - 1
        found.append(at < 0 or ends[at][1] <= a)
    return found


def labelled(text: str) -> tuple[list[Span], list[tuple[Span, int]]]:
    """The rules' spans; and proposals and rules' spans, each with its marks: a rule accepts (nearly) this span, it overlaps none."""
    base, proposed = base_spans(text), set(proposals(text))
    found = sorted(proposed | set(base), key=lambda s: (s[1], s[0], s[2]))
    ends = {(k, b): a for k, a, b in base}

    def accepted(span: Span) -> bool:
        a = ends.get((span[0], span[2]))
        return a is not None and -3 <= span[1] - a <= 4

    free = apart(found, [(a, b) for _, a, b in base])
    return base, [(s, ACCEPTED * accepted(s) + APART * (f and s in proposed)) for s, f in zip(found, free)]


def staged_spans(docs: DataFrame) -> DataFrame:
    """Staged, for every document (``id``, ``text``): ``id, fold, base, spans, x``.

    ``base`` holds kind, start, end of the rules' spans, ``spans`` these and the marks of all, ``x`` their features, one after another.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole.num_rows, HANDED):
                batch = whole.slice(part.start, part.stop - part.start)
                bases, spans, x = [], [], []
                for text in batch.column(2).to_pylist():
                    base, found = labelled(text)
                    bases.append([v for s in base for v in s])
                    spans.append([v for s, mark in found for v in (*s, mark)])
                    x.append([v for s, _ in found for v in features(text, s)])
                columns = [pa.array(bases, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "fold", "base", "spans", "x"])

    kind = docs.schema["id"].dataType.simpleString()
    fold = F.pmod(F.xxhash64("id", "text"), F.lit(FOLDS)).cast("int").alias("fold")
    found = docs.select("id", fold, "text").mapInArrow(read, f"id {kind}, fold int, base array<int>, spans array<int>, x array<float>")
    return staged(found, "personal-spans")


def fit(spans: DataFrame) -> tuple[Boosted | None, list[float]]:
    """Trees and a threshold per kind, in steps of the grid, from all spans of ``staged_spans``.

    Without proposals of both labels there are no trees, and only the rules count.
    """
    width, thresholds = len(features("", (0, 0, 0))), [np.inf] * len(KINDS)
    some = spans.filter(F.size("spans") > 0).select("fold", "spans", "x")

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = batch.column(1).flatten().to_numpy().reshape(-1, 4)
        fold = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()) // 4)
        return fold, marks, batch.column(2).flatten().to_numpy().reshape(-1, width)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch)[2]
            for k in range(width):
                value, n = np.unique(x[:, k], return_counts=True)
                columns = [pa.array(np.full(len(n), k, np.int32)), pa.array(value.astype(float)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "value", "n"])

    counted = some.mapInArrow(values, "feature int, value double, n bigint").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    got = counted.groupBy("feature").agg(F.percentile("value", at, F.col("n")).alias("cuts")).collect()  # one row per feature
    if not got:
        return None, thresholds
    cuts = np.array([r.cuts for r in sorted(got, key=lambda r: r.feature)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, marks, x = unpacked(batch)
            b = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
            head = np.stack([fold == 0, marks[:, 0]], axis=1)
            key, own = np.unique(np.hstack([head, b]).astype(np.uint8), axis=0, return_inverse=True)
            own = own.ravel()
            n, pos = np.bincount(own, minlength=len(key)), np.bincount(own, marks[:, 3] & ACCEPTED, len(key))
            columns = [
                pa.array(key[:, 0] == 1),
                pa.array(key[:, 1].astype(np.int32)),
                pa.array([row.tobytes() for row in np.ascontiguousarray(key[:, 2:])], pa.binary()),
                pa.array(n.astype(np.int64)),
                pa.array(pos.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["unseen", "kind", "bins", "n", "pos"])

    table = some.mapInArrow(binned, "unseen boolean, kind int, bins binary, n bigint, pos bigint")
    table = staged(table.groupBy("unseen", "kind", "bins").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), "personal-bins")
    seen, unseen = table.filter("not unseen"), table.filter("unseen").select("kind", "bins", "n", "pos")
    n, pos = seen.agg(F.sum("n"), F.sum("pos")).first()
    if not n or pos in (0, n):
        return None, thresholds
    model = Boosted().fit_spread(seen.select("bins", "n", "pos"), cuts)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)
            cell = np.floor(model.judged(b) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), *batch.columns[2:]], ["kind", "cell", "n", "pos"])

    cells = unseen.mapInArrow(judged, "kind int, cell bigint, n bigint, pos bigint").groupBy("kind", "cell")
    ranked = sorted(cells.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect(), key=lambda r: -r.cell)  # the grid's rows at most
    for k in range(len(KINDS)):
        own = [r for r in ranked if r.kind == k]
        n, pos = np.cumsum([r.n for r in own]), np.cumsum([r.pos for r in own])
        good = np.flatnonzero((pos >= PRECISION * n) & (pos >= SUPPORT))
        if len(good):
            thresholds[k] = max(own[good[-1]].cell, GRID // 2)
    return model, thresholds


def decided(base: list[list[Span]], extra: list[tuple[int, Span]], x: np.ndarray, model: Boosted, thresholds: list[float]) -> list[list[Span]]:
    """Per text the rules' spans and those of ``extra`` (text, span) that the trees accept; of two that overlap the likelier."""
    added: list[list[tuple[int, int, int]]] = [[] for _ in base]  # start, end, kind: apart, by start
    if extra:
        p = model.probability(x)
        limit = np.array([thresholds[s[0]] for _, s in extra])
        for i in np.argsort(-p, kind="stable"):
            if np.floor(p[i] * GRID) < limit[i]:
                continue
            k, (kind, a, b) = extra[i]
            held = added[k]
            at = bisect_left(held, (a, a, -1))
            if (at == 0 or held[at - 1][1] <= a) and (at == len(held) or b <= held[at][0]):
                held.insert(at, (a, b, kind))
    return [sorted(own + [(k, a, b) for a, b, k in more], key=lambda s: (s[1], s[0], s[2])) for own, more in zip(base, added)]


def spans_of(texts: list[str], model: Boosted | None, thresholds: list[float]) -> list[tuple[list[Span], list[Span]]]:
    """Per text: the rules' spans, and all spans. Added ones overlap no other; the likelier of two wins."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    extra: list[tuple[int, Span]] = []
    for k, (text, own) in enumerate(zip(texts, base)):
        found = proposals(text)
        extra += [(k, s) for s, free in zip(found, apart(found, [(a, b) for _, a, b in own])) if free]
    x = np.array([features(texts[k], s) for k, s in extra])
    return list(zip(base, decided(base, extra, x, model, thresholds)))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Every span replaced by the name of its kind; of overlapping spans the part not yet replaced."""
    parts, end = [], 0
    for k, a, b in spans:
        if b > end:
            parts += [text[end : max(a, end)], f"[{KINDS[k]}]"]
            end = b
    return "".join(parts) + text[end:]


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_email, n_ip, n_card, n_phone, base_spans, spans`` (and ``redacted``).

    Counts and ``base_spans`` are the rules' alone; ``spans`` adds what the trees accept. Spans are
    kind:start:end in code points, comma-joined, by start, then kind. A NULL or empty text has none
    (``redacted`` of NULL is empty). Repeated rows get equal rows; NULL ids are kept; an empty table gives none.
    Texts are read whole; rules and proposals take time in proportion to them. The spans of all documents are a staged
    table, from which the trees are fitted when called.
    """
    plain = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found_spans = staged_spans(plain)
    shared = shared_value(docs.sparkSession, fit(found_spans))
    names = ["id", *[f"n_{k}" for k in KINDS], "base_spans", "spans", "redacted"]

    def columns(spans: list[tuple[list[Span], list[Span]]], text: list[str | None]) -> list[pa.Array]:
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in spans], pa.int64()) for k in range(len(KINDS))]
        return counts + [pa.array(v, pa.string()) for v in ([written(b) for b, _ in spans], [written(s) for _, s in spans], text)]

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = spans_of(texts, *shared.value)
            text = [redacted(t, s) for t, (_, s) in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(spans, text)], names)

    def from_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, thresholds = shared.value
        width = len(features("", (0, 0, 0)))
        for batch in batches:
            base, extra, x = [], [], []
            for k, (own, marked, values) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)])):
                base.append(list(zip(own[::3], own[1::3], own[2::3])))
                for at, mark in enumerate(marked[3::4]):
                    if mark & APART:
                        extra.append((k, tuple(marked[4 * at : 4 * at + 3])))
                        x.append(values[width * at : width * at + width])
            every = base if model is None else decided(base, extra, np.array(x), model, thresholds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(list(zip(base, every)), [None] * len(base))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_spans string, spans string, redacted string"
    if keep_text:
        return plain.mapInArrow(from_texts, schema).withColumnRenamed("id", id_col)
    return found_spans.select("id", "base", "spans", "x").mapInArrow(from_spans, schema).withColumnRenamed("id", id_col).drop("redacted")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in the text replaced by its kind; NULL stays NULL."""
    plain = docs.select(F.col(text_col).alias("id"), text_of(text_col).alias("text"))
    shared = shared_value(docs.sparkSession, fit(staged_spans(plain).drop("id")))
    at = docs.columns.index(text_col)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, thresholds = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = spans_of([t or "" for t in texts], model, thresholds)
            new = [t if t is None else redacted(t, s) for t, (_, s) in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(replaced, docs.schema)
