"""Substring deduplication by seed and extend, on words.

Documents meet on winnowed anchors (``repeats``). Occurrences of an anchor are extended word by word both ways:
after j words to the left, and after j to the right, occurrences carry the class of what they have read so far, so
that two of them share a window exactly if they are in one left class and one right class whose depths add up. No
pairs are made, and runs of covered words add up to the maximal repeats of at least ``length`` words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyline.llm import textops as T
from tallyline.llm.repeats import Units, groups, removed, repeated


def extend(key: np.ndarray, left: np.ndarray, doc: np.ndarray, pos: np.ndarray, frags: list[bytes], u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the windows that have a match elsewhere among the fragments of their anchor."""
    values, first, last, _ = u.of(frags)
    size, n, width = last - first, len(key), u.slack + 1
    seed = T.mix(key)
    lefts, rights = [seed], [seed]
    for j in range(1, width):
        at = np.where(left - j >= 0, first + left - j, 0)
        lefts.append(T.mix(lefts[-1] * T.U64(0x9E3779B97F4A7C15) + values[at]))
        at = left + u.gram + j - 1
        at = np.where(at < size, first + at, 0)
        rights.append(T.mix(rights[-1] * T.U64(0xC2B2AE3D27D4EB4F) + values[at]))
    docs, starts = [], []
    for o in range(width):
        ok = np.flatnonzero((left >= o) & (left - o + u.length <= size))
        if len(ok) < 2:
            continue
        x, y, d, p = lefts[o][ok], rights[width - 1 - o][ok], doc[ok], (pos + left)[ok] - o
        order = np.lexsort((p, d, y, x))
        x, y, d, p = x[order], y[order], d[order], p[order]
        gone = repeated(groups(x, y), d, p, u.first_stays)
        docs.append(d[gone])
        starts.append(p[gone])
    none = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(starts)) if docs else (none, none)


def substring_dedup(documents: DataFrame, length: int = 35, gram: int = 12) -> DataFrame:
    """Removes every word covered by a window of ``length`` words that also starts anywhere else.

    Words are maximal runs of bytes other than blank, tab, LF, VT, FF and CR; windows lie in one document and are
    judged on the input. Returns documents' columns and n_units (words), n_removed,
    removed_spans (word ranges), kept (binary: kept words joined by one blank).

    Null text: no words. A null doc_id: the row stays whole and matches nothing. A document is a (doc_id, text): rows that repeat
    both are one occurrence, do not remove each other and get one result; one doc_id with several texts is several
    documents. Other columns are kept; those named like a result (whatever their case) are replaced. Texts shorter
    than ``length`` words stay whole. An empty table gives an empty result.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    u = Units(True, length, gram, False)
    return removed(documents, u, extend)
