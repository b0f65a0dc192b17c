"""Quality rules from a word suffix array: repeated substrings of a document, how much of it they cover and how long they get."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcols import _IS_SPACE, Words, passes, prepare_workers, split_words, text_buffer

#: A repeat counts from LEAST words on; repeats may cover MAX_COVERED of a document's words, and the longest may have MAX_LONGEST words.
LEAST, MAX_COVERED, MAX_LONGEST = 8, 0.3, 300

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, words that each shares with the one before it); suffixes end with their document, and documents stay apart.

    Ranks by the first 1, 2, 4, ... words; each round sorts only suffixes that still tie. The ranks of all rounds then give the common prefixes
    of neighbours by halving steps.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.append(True, key[order][1:] != key[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    history, width = [], 1
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    active = order[tied]
    while len(active):
        history.append(np.append(rank, -1).astype(np.int32))
        after = active + width
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[active[inside]]
        second = np.full(len(active), -1)
        second[inside] = rank[after[inside]]
        first = rank[active]
        again = np.lexsort((second, first))
        active, first, second = active[again], first[again], second[again]
        group = np.append(True, first[1:] != first[:-1])
        head = group | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(active))
        rank[active] = first + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        active = active[~(head & np.append(head[1:], True))]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for j in range(len(history) - 1, -1, -1):
        same = history[j][a] == history[j][b]
        a[same] += 1 << j
        b[same] += 1 << j
        common[1:][same] += 1 << j
    return order, common


def _maximal_repeats(order: np.ndarray, common: np.ndarray, codes: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Documents of the maximal repeated substrings of `least` or more words, one entry for each.

    These are the intervals of the suffix array whose common prefix cannot grow to the right and, as the words before it differ, not to the left.
    """
    before = np.where((order > 0) & (doc[np.maximum(order - 1, 0)] == doc[order]), codes[np.maximum(order - 1, 0)], -1 - order)
    changes = np.append(0, np.cumsum(before[1:] != before[:-1]))
    at = np.flatnonzero(common >= least)
    found: list[int] = []
    stack: list[tuple[int, int]] = []  # (common words, first row) of open intervals
    last = -2
    for i, words in [*zip(at.tolist(), common[at].tolist(), strict=True), (-1, 0)]:
        if i != last + 1 or i < 0:
            while stack:
                _, low = stack.pop()
                if changes[last] > changes[low]:
                    found.append(low)
        low = i - 1
        while stack and stack[-1][0] > words:
            _, low = stack.pop()
            if changes[i - 1] > changes[low]:
                found.append(low)
        if i >= 0 and (not stack or stack[-1][0] < words):
            stack.append((words, low))
        last = i
    return doc[order[found]] if found else np.zeros(0, np.int64)


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1))[:n] > 0


def _measures(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = text_buffer(column)
    words: Words = split_words(data, offsets)
    rows, n, doc = len(column), len(words.values), words.doc_of
    per_doc = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    codes = words.values.dictionary_encode().indices.to_numpy().astype(np.int64)
    order, common = suffix_array(codes, doc)
    repeat = np.zeros(n, np.int64)
    repeat[order] = np.maximum(common, np.append(common[1:], 0))
    # the longest repeat that starts at a word holds all others that do, so these spans have the same union as all repeats' occurrences
    long = np.flatnonzero(repeat >= LEAST)
    thrice = np.flatnonzero(repeat >= 3)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, doc[long], repeat[long])
    raw, dup = data.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(words.doc_offsets),
        "word_chars": per_doc(~_IS_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_doc(_SYMBOL[data]),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": np.bincount(doc[_covered(thrice, np.full(len(thrice), 3), n)], minlength=rows),
        "n_covered": np.bincount(doc[_covered(long, repeat[long], n)], minlength=rows),
        "longest_repeat": longest,
        "n_maximal": np.bincount(_maximal_repeats(order, common, codes, doc, LEAST), minlength=rows),
    }


def repetition_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, the measures of each whole text, base_failed and kept for every row of `docs` (doc_id, text).

    n_covered: words in repeated substrings of LEAST or more words; longest_repeat: words of the longest; n_maximal: how many there are. A text
    is kept if it doesn't fail the base rules and stays within both limits. Null and empty texts have no words and fail; texts of any length are
    measured whole, repeated rows each get their row, and other columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_maximal"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                m = _measures(part.column("text"))
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in names), pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean")
