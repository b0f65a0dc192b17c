"""Fill-in-middle: texts cut at two unit borders and written as prefix, suffix, middle or suffix, prefix, middle, each behind its mark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcols import passes, prepare_workers, text_buffer
from .wavelet import Wavelet

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts RATE are transformed, and of 100 transformed ones SPM begin with the suffix.
SEED, RATE, SPM = 7, 100, 50

#: Classes of UTF-8 bytes. A character is its first byte; further bytes of it are TAIL.
OTHER, NEWLINE, SPACE, STOP, LETTER, DIGIT, WIDE, TAIL = range(8)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[32, 9, 11, 12, 13]] = SPACE
_CLASS[10] = NEWLINE
_CLASS[list(b".!?")] = STOP
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
_CLASS[list(b"0123456789")] = DIGIT
_CLASS[0xC0:] = WIDE
_CLASS[0x80:0xC0] = TAIL
#: A unit ends behind each character of these classes, and with the text.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, SPACE)}


def cuts(data: np.ndarray, offsets: np.ndarray, unit: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut, characters before the first, between both) of each text; `draws` holds two numbers for each.

    A wavelet matrix over the byte classes of all texts counts units by combined ranks, finds both cuts by bisection on them, and counts
    characters as places that are no TAIL.
    """
    start, end, ends = offsets[:-1], offsets[1:], UNITS[unit]
    matrix = Wavelet(_CLASS[data], 3)
    borders = matrix.count(ends, start, end)
    n = borders + (matrix.behind(ends, start, end, borders) < end)
    after = np.sort(draws % (n + 1)[:, None].astype(np.uint64), axis=1).astype(np.int64)
    first, second = (np.where(wanted == n, end, matrix.behind(ends, start, end, wanted)) for wanted in after.T)
    characters = lambda a, b: b - a - matrix.count((TAIL,), a, b)
    return n, first, second, characters(start, first), characters(first, second)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "line") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output for every row of `docs` (doc_id, text).

    Both cuts, whether a text is transformed and its form are drawn from the SHA-256 of seed and doc_id, so every run gives the same. Texts that
    are empty or null, or hold one of the marks, stay plain, so that `restored` always gives the text back. Whole texts of any length are cut;
    repeated rows each get their row, a null doc_id draws as an empty one, and other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    prepare_workers(docs.sparkSession)
    marks = p, s, m = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                data, offsets = text_buffer(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
                draws = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.uint64)
                n, first, second, before, between = cuts(data, offsets, unit, draws[:, :2])
                raw, forms, outputs = data.tobytes(), [], []
                for i, (low, a, b, high) in enumerate(zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), strict=True)):
                    text = raw[low:high]
                    if not text or draws[i, 2] % 100 >= rate or any(x in text for x in marks):
                        forms.append("plain")
                        outputs.append(text)
                    elif draws[i, 3] % 100 < spm:
                        forms.append("spm")
                        outputs.append(b"".join((s, raw[b:high], p, raw[low:a], m, raw[a:b])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p, raw[low:a], s, raw[b:high], m, raw[a:b])))
                plain = np.array([f == "plain" for f in forms], bool)
                long = lambda x: pa.array(x, pa.int64(), mask=plain)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), long(before), long(between), pa.array(outputs, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that `fill_in_middle` has given this output and form for; each mark occurs once in an output that isn't plain."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    head = lambda mark: F.substring(F.substring_index(output, mark, 1), 4, 2**31 - 1)
    inner = lambda mark: F.substring_index(F.substring_index(output, mark, -1), MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(head(SUFFIX), middle, inner(SUFFIX))).when(form == "spm", F.concat(inner(PREFIX), middle, head(PREFIX))).otherwise(output)


def cut_digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle by lines, with digests in place of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))
