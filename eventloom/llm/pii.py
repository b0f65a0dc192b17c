"""Personal data in texts: exact base spans per kind, and a semi-Markov conditional random field that scores whole candidate spans.

Fields are letters, digits or single signs; only clusters of words with a digit or an at sign can hold entities, and everything between them
has score zero, so the field is decoded cluster by cluster. A segment of up to MAX_FIELDS fields gets the weights of its features for each
kind and of the move from the kind before it; fields outside all entities are segments of one. Dynamic programming over segment ends chooses
boundaries and kinds together. Weights maximise the conditional likelihood of whole segmentations over clusters of a bounded sample, with the
base spans as labels and features that leave out what the base patterns demand, so that other spellings score too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import passes, prepare_workers

KINDS = ("email", "ip", "card", "phone")
#: Fields of a segment, and about how many an example that weights are learnt from has (longer clusters give several; they are decoded whole).
MAX_FIELDS, CLUSTER_FIELDS = 24, 200
#: Documents that give examples, and examples that are learnt from, those with the smallest hashes.
FIT_DOCS, FIT_CLUSTERS = 600, 1500
#: Passes over the examples, step of a feature's first update, and weight decay of a pass.
EPOCHS, STEP, DECAY = 4, 0.5, 1e-3
#: A span beyond the base ones is reported if it scores this much above leaving its fields alone.
MARGIN = 2.0
#: States of the field: outside, then the kinds. Weights of moves stand under these names, a value for each state to move to.
_MOVES = ["move outside", *(f"move {k}" for k in KINDS)]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_FIELD = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_CLUSTER = re.compile(r"[^ \t-\r]*[0-9@][^ \t-\r]*(?:[ ][^ \t-\r]*[0-9@][^ \t-\r]*)*")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base spans, sorted. Each kind's matches are the leftmost that don't overlap; failing ones are dropped."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and _LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((begin, 0, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    ip_free = card_free = 0
    for run in _DIGITS.finditer(text):
        s = run.start()
        if s >= ip_free and text[run.end() : run.end() + 1] == "." and (m := _IP.match(text, s)):
            ip_free = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((s, 1, ip_free))
        if s >= card_free and (m := _CARD.match(text, s)):
            card_free = m.end()
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((s, 2, card_free))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(found)


def clusters(text: str, base: list[tuple[int, int, int]] | None = None) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """(offset, fields) of the stretches that can hold entities; where base spans are given, as examples to learn from, cut after CLUSTER_FIELDS or
    more fields outside of them, at spaces where there are any."""
    if not _ANCHOR.search(text):
        return
    for m in _CLUSTER.finditer(text) if len(text) < 1 << 16 else _clusters_of_long(text):
        fields = [(m.start() + f.start(), m.start() + f.end(), f.group()) for f in _FIELD.finditer(m.group())]
        low, known, reach = 0, 0, 0
        for i, (start, end, sign) in enumerate(fields if base is not None else ()):
            while known < len(base) and base[known][0] < end:
                reach = max(reach, base[known][2])
                known += 1
            # no segment is as long as eight times CLUSTER_FIELDS, so the last of these cuts none
            if i - low >= CLUSTER_FIELDS * (8 if reach > start else 1 if sign == " " else 4):
                yield fields[low][0], fields[low:i]
                low = i
        yield fields[low][0], fields[low:]


class _Stretch:
    def __init__(self, start: int, text: str):
        self.start, self.group = lambda: start, lambda: text


def _clusters_of_long(text: str) -> Iterator[_Stretch]:
    """The matches of _CLUSTER, found word by word, so that long words don't make it try each of their ends."""
    held: list[re.Match] = []
    for word in re.finditer(r"[^ \t-\r]+", text):
        if held and not (word.start() == held[-1].end() + 1 and text[held[-1].end()] == " " and _ANCHOR.search(word.group())):
            yield _Stretch(held[0].start(), text[held[0].start() : held[-1].end()])
            held = []
        if _ANCHOR.search(word.group()):
            held.append(word)
    if held:
        yield _Stretch(held[0].start(), text[held[0].start() : held[-1].end()])


def span_features(span: str) -> tuple[str, ...]:
    """Features of a whole span: its outline, sizes, signs and checks."""
    digits = re.sub("[^0-9]", "", span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall("[0-9]+", span)
    outline = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", span))
    return (
        f"outline {outline[:24]}",
        f"digits {min(len(digits), 20)} letters {min(letters, 3)}",
        f"groups {','.join(str(min(len(g), 9)) for g in groups[:8])} letters {min(letters, 1)}",
        f"at {span.count('@')} dots {min(span.count('.'), 6)} groups {min(len(groups), 6)} letters {min(letters, 1)}",
        f"luhn {12 <= len(digits) <= 19 and luhn(digits)} letters {min(letters, 1)}",
        f"octets {len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)} dots {span.count('.') == 3} letters {min(letters, 1)}",
        f"first {outline[:1]} last {outline[-1:]}",
    )


def _bounds(fields: list[tuple[int, int, str]]) -> tuple[list[bool], list[bool], list[int]]:
    """Whether a segment may begin and may end at each field, and how many fields before each place have a digit or an at sign."""
    begins = [f[2].isalnum() or f[2] in "+(" for f in fields]
    marks = [0]
    for f in fields:
        marks.append(marks[-1] + (f[2][0] in "0123456789@"))
    return begins, [f[2].isalnum() for f in fields], marks


class Field:
    """Weights by feature name (a value per kind) and of moves, and the decoder."""

    def __init__(self, weights: dict[str, list[float]]):
        self.weights, self.memo = weights, {}
        self.move = [weights.get(name, [0.0] * len(_MOVES)) for name in _MOVES]

    def scores(self, span: str) -> list[float]:
        if (found := self.memo.get(span)) is None:
            rows = [w for f in span_features(span) if (w := self.weights.get(f))]
            found = [sum(r[k] for r in rows) for k in range(len(KINDS))]
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[span] = found
        return found

    def decode(self, fields: list[tuple[int, int, str]]) -> list[tuple[int, int, int, float]]:
        """The entities (start, kind, end, gain) of the best segmentation; the gain of each is over leaving its fields outside."""
        n, states, move, never = len(fields), len(_MOVES), self.move, float("-inf")
        text = "".join(f[2] for f in fields)
        origin = fields[0][0]
        low, high = [f[0] - origin for f in fields], [f[1] - origin for f in fields]
        begins, ends, marks = _bounds(fields)
        # best[j][y]: score of the best segmentation of the first j fields that ends in state y; enter[j][y]: that score and the move on to y
        best, back, enter, come = [[0.0] + [never] * (states - 1)], [[None] * states], [], []
        for j in range(n + 1):
            if j:
                now, via = [never] * states, [None] * states
                now[0], via[0] = enter[j - 1][0], (j - 1, come[j - 1][0])
                if ends[j - 1]:
                    for i in range(max(0, j - MAX_FIELDS), j):
                        if begins[i] and marks[j] > marks[i]:
                            into = enter[i]
                            for y, score in enumerate(self.scores(text[low[i] : high[j - 1]]), 1):
                                if into[y] + score > now[y]:
                                    now[y], via[y] = into[y] + score, (i, come[i][y])
                best.append(now)
                back.append(via)
            live = [y for y in range(states) if best[j][y] > never]
            come.append([max(live, key=lambda y: best[j][y] + move[y][z]) for z in range(states)] if len(live) > 1 else [0] * states)
            enter.append([best[j][y] + move[y][z] for z, y in enumerate(come[j])])
        path, j = [], n
        y = max(range(states), key=best[n].__getitem__)
        while j:
            i, before = back[j][y]
            path.append((i, j, y, before))
            j, y = i, before
        out, after = [], None
        for i, j, y, before in path:
            if y:
                score = self.scores(text[low[i] : high[j - 1]])[y - 1] + move[before][y] - move[before][0] - (j - i - 1) * move[0][0]
                out.append((fields[i][0], y - 1, fields[j - 1][1], score + (move[y][after] - move[0][after] if after is not None else 0.0)))
            after = y
        return out[::-1]


class Lattice:
    """All segments that a cluster can have, and sums over all of its segmentations."""

    def __init__(self, fields: list[tuple[int, int, str]], names: dict[str, int]):
        """names: the number of each feature; new ones are added."""
        text, origin = "".join(f[2] for f in fields), fields[0][0]
        begins, ends, marks = _bounds(fields)
        self.n = len(fields)
        spans = [(i, j) for j in range(1, self.n + 1) if ends[j - 1] for i in range(max(0, j - MAX_FIELDS), j) if begins[i] and marks[j] > marks[i]]
        self.place = {(fields[i][0], fields[j - 1][1]): m for m, (i, j) in enumerate(spans)}
        self.low, self.high = (np.array([x[k] for x in spans], np.int64) for k in (0, 1))
        rows = [[names.setdefault(f, len(names)) for f in span_features(text[fields[i][0] - origin : fields[j - 1][1] - origin])] for i, j in spans]
        self.features = np.array(rows, np.int64).reshape(len(spans), len(rows[0]) if rows else 0)
        #: segments by where they end and by where they begin
        self.ending, self.starting = ([np.flatnonzero(x == j) for j in range(self.n + 1)] for x in (self.high, self.low))

    def sums(self, scores: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log of the sum over all segmentations, probability of each segment and kind, expected number of each move)."""
        n, states = self.n, len(move)
        into = np.full((n + 1, states), -np.inf)  # log sums of what comes before a segment of each state, with the move to it
        onto = np.full((n + 1, states), -np.inf)  # log sums of what comes after a segment of each state that ends there
        alpha = np.full((n + 1, states), -np.inf)
        alpha[0, 0] = 0.0
        for j in range(n + 1):
            if j:
                alpha[j, 0] = into[j - 1, 0]
                if len(m := self.ending[j]):
                    alpha[j, 1:] = np.logaddexp.reduce(into[self.low[m], 1:] + scores[m], axis=0)
            into[j] = np.logaddexp.reduce(alpha[j][:, None] + move, axis=0)
        onto[n] = 0.0
        total = float(np.logaddexp.reduce(alpha[n]))
        moves = np.zeros_like(move)
        for j in range(n - 1, -1, -1):
            ahead = np.full(states, -np.inf)  # what follows, with the score of the segment that begins here, by its state
            ahead[0] = onto[j + 1, 0]
            if len(m := self.starting[j]):
                ahead[1:] = np.logaddexp.reduce(scores[m] + onto[self.high[m], 1:], axis=0)
            onto[j] = np.logaddexp.reduce(move + ahead, axis=1)
            moves += np.exp(alpha[j][:, None] + move + ahead - total)
        share = np.exp(into[self.low, 1:] + scores + onto[self.high, 1:] - total)
        return total, share, moves


def _labels(fields: list[tuple[int, int, str]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans inside a cluster without overlaps, earlier kinds first."""
    low, high, kept = fields[0][0], fields[-1][1], []
    for s, k, e in sorted(base, key=lambda x: x[1]):
        if low <= s and e <= high and all(e <= a or b <= s for a, _, b in kept):
            kept.append((s, k, e))
    return kept


def learn(examples: list[tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]]) -> dict[str, list[float]]:
    """Weights that maximise the conditional likelihood of the examples' segmentations, by adaptive steps along its gradient."""
    names: dict[str, int] = {}
    ready = []
    for fields, gold in examples:
        lattice = Lattice(fields, names)
        # a span that no segment can have, as it begins or ends within other signs, stays outside
        spans = sorted((lattice.place[s, e], k) for s, k, e in gold if (s, e) in lattice.place)
        moves, state, at = np.zeros((len(_MOVES), len(_MOVES))), 0, 0
        for m, k in spans:
            for y in [0] * int(lattice.low[m] - at) + [k + 1]:
                moves[state, y] += 1
                state = y
            at = lattice.high[m]
        for _ in range(int(lattice.n - at)):
            moves[state, 0] += 1
            state = 0
        own = np.zeros((len(lattice.low), len(KINDS)))
        own[[m for m, _ in spans], [k for _, k in spans]] = 1.0
        ready.append((lattice, own, moves))
    w, move = np.zeros((len(names), len(KINDS))), np.zeros((len(_MOVES), len(_MOVES)))
    seen, seen_move = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    for _ in range(EPOCHS):
        for lattice, own, moves in ready:
            scores = w[lattice.features].sum(1) if len(lattice.low) else np.zeros((0, len(KINDS)))
            _, share, expected = lattice.sums(scores, move)
            touched, back = np.unique(lattice.features, return_inverse=True)
            step = np.zeros((len(touched), len(KINDS)))
            np.add.at(step, back.reshape(lattice.features.shape), (own - share)[:, None, :])
            seen[touched] += step**2
            w[touched] += STEP * step / np.sqrt(seen[touched])
            seen_move += (moves - expected) ** 2
            move += STEP * (moves - expected) / np.sqrt(seen_move)
        w *= 1 - DECAY
    return {**{f: w[i].tolist() for f, i in names.items() if w[i].any()}, **dict(zip(_MOVES, move.tolist(), strict=True))}


def fit(docs: DataFrame, rows: int = FIT_DOCS) -> dict[str, list[float]]:
    """Weights from at most FIT_CLUSTERS clusters, those with the smallest hashes, of the `rows` documents with the smallest hash of doc_id."""
    prepare_workers(docs.sparkSession)
    chosen = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for _, fields in clusters(text or "", base):
                    gold = _labels(fields, base)
                    yield pa.RecordBatch.from_arrays([pa.array([fields[0][0]], pa.int64()), pa.array(["".join(f[2] for f in fields)]), pa.array([[x for g in gold for x in g]], pa.list_(pa.int64()))], ["start", "text", "gold"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(examples, "start long, text string, gold array<long>")
    found = found.orderBy(F.xxhash64("text", "start"), "text", "start", "gold").limit(FIT_CLUSTERS).collect()
    ready = [([(r.start + m.start(), r.start + m.end(), m.group()) for m in _FIELD.finditer(r.text)], [tuple(r.gold[i : i + 3]) for i in range(0, len(r.gold), 3)]) for r in found]
    return learn(ready)


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base spans and what the field adds where no base span is)."""
    base = base_spans(text)
    extra = [(s, k, e) for _, fields in clusters(text) for s, k, e, score in field.decode(fields) if score >= MARGIN and all(e <= a or b <= s for a, _, b in base)]
    return base, sorted([*base, *extra])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    Null and empty texts have none, texts of any length are searched whole, repeated rows each get their row, and extra columns are ignored.
    """
    import hashlib

    weights = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights.value)
        for batch in batches:
            for part in passes(batch):
                counts, digests, spans = [[] for _ in KINDS], [], []
                for text in part.column("text").to_pylist():
                    base, every = all_spans(text or "", field)
                    for k in range(len(KINDS)):
                        counts[k].append(sum(x[1] == k for x in base))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span's place holds its kind in brackets; spans that overlap count as one, with the kind of the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with all personal data in `text` replaced; a column n_chars is brought up to date, all other columns and rows stay."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights.value)
        for batch in batches:
            for part in passes(batch):
                columns = dict(zip(names, part.columns, strict=True))
                texts = [None if t is None else redact(t, all_spans(t, field)[1]) for t in columns["text"].to_pylist()]
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([n if t is None or t == old else len(t) for n, t, old in zip(columns["n_chars"].to_pylist(), texts, columns["text"].to_pylist(), strict=True)], columns["n_chars"].type)
                columns["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(rows, docs.schema)
