"""Removal of repeated byte strings by longest-previous-factor arrays.

Windows are anchored at the smallest hash of a shorter string inside them.  Windows
whose anchor occurs twice come together in blocks of whole anchors, in order of place,
and are put in suffix order with the lengths that neighbours share.  The previous and
the next smaller place in that order give each window its longest previous factor (cut
at the width) and where it starts earlier: a factor of full width is a repeat, and the
window it is taken from is the earlier copy.  Windows under an anchor that very many
batches post are compared by hash, without being sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carryover.llm.repeats import Method, Rolling, Runs, U, byte_letters, covered, runs_of, with_repeats

#: Bytes of a repeat, and of the shorter string that anchors it.
WIDTH, ANCHOR = 400, 100
_PLACE = 22
#: Windows sorted side by side.
SORTED = 1 << 14


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbouring values, by the first of them."""
    n = -len(values) % span
    grid = np.concatenate([values, np.full(n, np.iinfo(U).max, U)]).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    k = len(values) - span + 1
    return np.minimum(behind[:k], ahead[span - 1 : span - 1 + k])


def anchored(width: int, anchor: int):
    def anchors(letters: np.ndarray, starts: np.ndarray) -> Runs:
        grams = Rolling(byte_letters(letters)).every(anchor)
        order = (grams >> U(_PLACE) << U(_PLACE)) | np.arange(len(grams), dtype=U)
        place = (smallest(order, width - anchor + 1)[starts] & U((1 << _PLACE) - 1)).astype(np.int64)
        return runs_of(starts, place, grams[place])

    return anchors


def suffix_order(raw: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the windows at ``start``, and how much each shares with the one before.

    Windows come in order of place and equal ones keep it.  They are dealt by their first
    word and sorted some thousands at a time, so that few stand side by side as copies.
    """
    words = np.ndarray((len(raw),), ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    head = words[start].astype(U) >> U(8 * max(0, 8 - width))
    order = np.argsort(head, kind="stable")
    head = head[order]
    share = np.zeros(len(order), np.int64)
    share[1:] = np.minimum(_common(head[1:], head[:-1]) - max(0, 8 - width), width)
    cut = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(order)]])
    many = np.diff(cut)
    cut, many = cut[:-1][many > 1], many[many > 1]
    grid = np.lib.stride_tricks.sliding_window_view(raw, width)
    k = 0
    while width > 8 and k < len(cut):
        n = max(1, int(np.searchsorted(np.cumsum(many[k : k + SORTED]), SORTED, "right")))
        at = np.repeat(cut[k : k + n] - (np.cumsum(many[k : k + n]) - many[k : k + n]), many[k : k + n])
        at += np.arange(len(at))
        own = order[at]
        copies = np.ascontiguousarray(grid[start[own]])
        new = np.argsort(copies.view(f"S{width}").ravel(), kind="stable")
        order[at] = own[new]
        for lo in range(1, len(new), SORTED):
            here, before = copies[new[lo : lo + SORTED]], copies[new[lo - 1 : lo - 1 + SORTED]][: len(new) - lo]
            differ = here != before
            found = differ.argmax(1)
            found[~differ[np.arange(len(found)), found]] = width
            inside = at[lo : lo + SORTED]
            # a window of another head than the one before keeps what the heads share
            share[inside] = np.where(head[inside] == head[inside - 1], found, share[inside])
        k += n
    return order, share


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that words have in common."""
    return 8 - np.searchsorted(U(1) << (U(8) * np.arange(8, dtype=U)), a ^ b, "right")


def previous_smaller(place: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the last one before it with a smaller place (-1: none), and what the two share.

    Every entry starts at its neighbour.  All that lies between an entry and the one it
    points at has larger places, so one that points at a larger place goes on to where
    that one points: pointers double.
    """
    to, least = np.arange(-1, len(place) - 1), share.copy()
    active = np.flatnonzero(to >= 0)
    while len(active):
        at = to[active]
        active, at = (x[place[at] > place[active]] for x in (active, at))
        least[active] = np.minimum(least[active], least[at])
        to[active] = to[at]
        active = active[to[active] >= 0]
    return to, np.where(to >= 0, least, 0)


def previous_factors(width: int):
    def factors(texts: list[bytes], runs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Length of each window's longest previous factor and the window it is taken from.

        The longest match that starts earlier is with the previous or the next smaller
        place in suffix order, whichever shares more.
        """
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ahead = np.cumsum(sizes) - sizes
        count = np.array(runs)
        start = np.repeat(ahead - (np.cumsum(count) - count), count) + np.arange(count.sum())
        order, share = suffix_order(raw, start, width)
        before, shared = previous_smaller(order, share)
        after, shared_after = previous_smaller(order[::-1], np.concatenate([[0], share[1:][::-1]]))
        after, shared_after = len(order) - 1 - after[::-1], shared_after[::-1]
        length, source = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        length[order] = np.maximum(shared, shared_after)
        earlier = np.where(shared >= shared_after, before, after)
        source[order] = np.where(np.maximum(shared, shared_after) > 0, order[np.clip(earlier, 0, len(order) - 1)], -1)
        return length, source

    return factors


def method(width: int = WIDTH) -> Method:
    return Method(width, lambda t: np.frombuffer(t, np.uint8), anchored(width, max(1, min(ANCHOR, width // 4))), False, previous_factors(width))


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Remove every byte of a string of ``width`` bytes that also starts elsewhere in the corpus.

    With ``keep_first`` only later copies go: by doc_id (absent ones last), row and
    place.  Strings are judged on the input; they may overlap and lie in one text; rows
    equal in id and text are one document.  A null text is empty; a text shorter than
    ``width`` stays whole.  Returns (doc_id, n_bytes, n_removed, n_spans, kept), where
    ``kept`` is the rest as bytes, or with ``digest`` kept_sha256.
    """
    found = with_repeats(docs, method(width), keep_first, doc_id, text)
    last, kind, arrow = ("kept_sha256", "string", pa.string()) if digest else ("kept", "binary", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for own_id, value, owns, starts in zip(batch.column(0), *batch.columns[2:]):
                raw = value.as_py()
                if starts.is_valid:
                    gone = covered(own_id.as_py(), owns.as_py(), starts.as_py(), width, len(raw))
                    rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                else:
                    rest = raw
                    spans.append(0)
                size.append(len(raw))
                removed.append(len(raw) - len(rest))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(x, pa.int64()) for x in (size, removed, spans)], pa.array(kept, arrow)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", last],
            )

    own = docs.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {own}, n_bytes long, n_removed long, n_spans long, {last} {kind}")
