"""Trees by a fixed rule, for a batch of sentences in Arrow.

The middle token is the root, every other token hangs on one of its next
neighbours towards the middle, chosen by its own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute

#: Tags by the first pattern that matches, for a form that none matches the last one.
TAGS = [
    (r"^\p{Lu}", "PROPN"),
    (r"^[0-9]", "NUM"),
    (r"^[^\p{L}\p{N}]+$", "PUNCT"),
    (r"(tion|ment|ung|ción)[.,]?$", "NOUN"),
    (r"^.{1,3}$", "DET"),
]
OTHER = "VERB"
# To a JVM regex, `.` is no line end, and `$` also stands before the last one; a form holds no \n and no \r.
_LINE_END = r"[\x{85}\x{2028}\x{2029}]"
_ARROW_PATTERNS = [
    re.sub(r"\$$", lambda _: f"{_LINE_END}?$", re.sub(r"^\^\.", lambda _: f"^{_LINE_END.replace('[', '[^')}", p)) for p, _ in TAGS
]
_TAG_NAMES = pa.array([name for _, name in TAGS] + [OTHER])
_LABELS = pa.array([f"{side}{k}" for side in ("l", "root", "r") for k in range(3)])


def _tags(forms: pa.Array) -> np.ndarray:
    """Numbers of tags; a pattern looks at the forms that earlier ones left."""
    tags = np.full(len(forms), len(TAGS))
    left = np.arange(len(forms))
    for number, pattern in enumerate(_ARROW_PATTERNS):
        found = compute.match_substring_regex(forms.take(pa.array(left)), pattern).to_numpy(zero_copy_only=False)
        tags[left[found]] = number
        left = left[~found]
    return tags


def _words(sentences: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all sentences one after another, and where each sentence begins (and the last one ends)."""
    lists = compute.split_pattern_regex(sentences, r"[ \t\n\x0B\f\r]+")
    words = lists.flatten()
    full = compute.not_equal(words, "").to_numpy(zero_copy_only=False)
    lengths = compute.fill_null(compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def grow(batches: Iterator[pa.RecordBatch], reach: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """``keys, forms, upos, heads, labels`` of rows with ``keys, sentence``.

    Tags and lengths are worked out for the distinct forms of a batch.
    """
    for batch in batches:
        forms, begins = _words(batch["sentence"])
        coded = compute.dictionary_encode(forms)
        which = coded.indices.to_numpy()
        upos = _TAG_NAMES.take(pa.array(_tags(coded.dictionary)[which]))
        length = compute.utf8_length(coded.dictionary).to_numpy().astype(np.int32)[which]
        n = np.diff(begins)
        at = np.arange(1, len(forms) + 1) - np.repeat(begins[:-1], n)
        n = np.repeat(n, n)
        m, spread = (n + 1) // 2, np.minimum(reach, 1 + n % 3)
        away = length % np.maximum(np.minimum(spread, np.abs(m - at)), 1)
        side = np.sign(at - m)
        heads = np.where(side == 0, 0, at - side * (1 + away))
        labels = _LABELS.take(pa.array((side + 1) * 3 + length % 3))
        offsets = pa.array(begins, pa.int32())
        arrays = [forms, upos, pa.array(heads, pa.int32()), labels]
        lists = [pa.ListArray.from_arrays(offsets, a) for a in arrays]
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *lists], [*keys, "forms", "upos", "heads", "labels"])
