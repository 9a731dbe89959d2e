"""Sets of hashed five-word shingles of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from tallyloom.llm.common import WordRows, mix

WIDTH = 5
#: Odd multipliers, one per place in the shingle.
PLACES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


class Shingler:
    """Text -> distinct hashed shingles, ascending. Words are separated by blanks and the ASCII controls 9 to 13, A-Z count
    as a-z. Fewer words than ``WIDTH`` make one shingle; no words, none."""

    def __init__(self):
        self.table = WordRows(self._hashed, 1, kind=np.uint64)

    @staticmethod
    def _hashed(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)[:, None]

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashed = self.table.of(words)[:, 0]
        width = min(WIDTH, len(hashed))
        with np.errstate(over="ignore"):
            total = np.full(len(hashed) - width + 1, width, np.uint64)
            for k in range(width):
                total = total + hashed[k : k + len(total)] * PLACES[k]
        return np.unique(mix(total))
