"""Entropy scores of many tokens at once, from their character counts.

The Arrow side of ``functions.entropy``: the same verdicts for whole batches
of lines. Scores within rounding of the threshold are left to the exact rule.
"""

from __future__ import annotations

# Tokens and bytes measured at a time; keeps the count tables small.
_CHUNK_TOKENS = 16384
_CHUNK_BYTES = 4 * 1024 * 1024
_MARGIN = 1e-6


class _Counts:
    """Character counts of an Arrow array of non-empty ASCII strings."""

    def __init__(self, strings) -> None:
        import numpy as np
        import pyarrow as pa

        raw = strings.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)
        self.size = np.diff(offsets)
        self.first = data[offsets[:-1]]
        row = np.repeat(np.arange(len(raw)), self.size)
        cells = row * 256 + data[offsets[0] : offsets[-1]]
        self.of = np.bincount(cells, minlength=len(raw) * 256).reshape(len(raw), 256)

    def total(self, chars: str):
        return self.of[:, [ord(c) for c in chars]].sum(axis=1)

    def entropy(self):
        import numpy as np

        share = self.of / self.size[:, None]
        return -(share * np.log2(share, where=share > 0, out=np.zeros_like(share))).sum(axis=1)

    def few_digits(self):
        digits = self.total("0123456789")
        return (digits <= 2) | (digits / self.size <= 0.15)

    def starts_with_letter(self):
        return ((self.first >= 65) & (self.first <= 90)) | ((self.first >= 97) & (self.first <= 122))

    def is_identifier(self):
        shape = (self.total("+/=-") == 0) & (self.starts_with_letter() | (self.first == ord("_")))
        return shape & self.few_digits() & (self.total("aeiouAEIOU") / self.size >= 0.3)

    def reads_as_name(self):
        import numpy as np

        upper, lower = self.of[:, 65:91].sum(axis=1), self.of[:, 97:123].sum(axis=1)
        constant = (self.first >= 65) & (self.first <= 90) & (lower == 0) & (self.total("-") == 0)
        wordy = self.total("aeiouAEIOU") / np.maximum(upper + lower, 1) >= 0.3
        shape = (self.total("+=") == 0) & self.starts_with_letter()
        return shape & self.few_digits() & ((self.size < 8) | constant | wordy)

    def scores(self):
        """(surely, possibly) over the threshold, for strings scored whole."""
        bits, eligible = self.entropy(), (self.size >= 20) & ~self.is_identifier()
        return eligible & (bits >= 4.2 + _MARGIN), eligible & (bits >= 4.2 - _MARGIN)


def _score_chunk(tokens):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = _Counts(tokens)
    sure, maybe = whole.scores()
    paths = np.flatnonzero(whole.total("/") > 0)
    if len(paths):
        lists = pc.split_pattern(tokens.take(pa.array(paths)), "/")
        segments = pc.list_flatten(lists)
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        filled = np.flatnonzero(pc.binary_length(segments).to_numpy(zero_copy_only=False) > 0)
        if len(filled):
            owner, parts = owner[filled], _Counts(segments.take(pa.array(filled)))
            count = np.bincount(owner, minlength=len(paths))
            odd = np.bincount(owner, weights=~parts.reads_as_name(), minlength=len(paths))
            split = (count >= 2) & (odd == 0)
            for verdict, of_part in zip((sure, maybe), parts.scores(), strict=True):
                any_part = np.bincount(owner, weights=of_part, minlength=len(paths)) > 0
                verdict[paths] = np.where(split, any_part, verdict[paths])
    # Bytes outside ASCII (text that is not UTF-8) are left to the exact rule.
    strange = whole.of[:, 128:].any(axis=1)
    return sure & ~strange, maybe | strange


def score_lines(lines):
    """Per line: holds a token surely, or possibly, over the threshold."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(lines, "[^A-Za-z0-9+/=_-]+")
    tokens = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    size = pc.binary_length(tokens).to_numpy(zero_copy_only=False)
    long_enough = np.flatnonzero(size >= 20)
    ends = np.cumsum(size[long_enough], dtype=np.int64)
    sure, maybe = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool)
    start = 0
    while start < len(long_enough):
        done = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, done + _CHUNK_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + _CHUNK_TOKENS)
        part = long_enough[start:stop]
        start = stop
        over, near = _score_chunk(tokens.take(pa.array(part)))
        sure[owner[part[over]]] = True
        maybe[owner[part[near]]] = True
    return sure, maybe
