"""Text encoders used inside Python workers.

An encoder is any callable turning a list of strings into a float matrix with
one row per string. Jobs take a factory for it, called once per worker task,
so a model is loaded where it is used and never shipped from the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the token axis, counting real tokens only."""
    weight = mask[..., None].astype("float64")
    total = (hidden * weight).sum(axis=1)
    return total / np.maximum(weight.sum(axis=1), 1.0)


def pooled(
    model: Callable[[], Callable[[list[str], int], tuple[np.ndarray, np.ndarray]]],
    max_tokens: int = 512,
) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder from a model of tokens: the mean of a text's token vectors.

    The model is made once per task and turns texts and a limit of tokens into
    (hidden, mask) of the batch. What lies beyond the limit is cut here if the
    model has not done so, and padding is never counted, so a text's vector does
    not depend on its batch.
    """
    if max_tokens < 1:
        raise ValueError(f"max_tokens must be at least 1, got {max_tokens}")

    def make() -> Callable[[list[str]], np.ndarray]:
        tokens_of = model()

        def encode(texts: list[str]) -> np.ndarray:
            hidden, mask = tokens_of(texts, max_tokens)
            return masked_mean(hidden[:, :max_tokens], mask[:, :max_tokens])

        return encode

    return make


class HashedWords:
    """Model-free encoder: each word's MD5 digits are its vector, texts average them.

    Values are multiples of one half, so sums are exact and the result does not
    depend on word order or batching.
    """

    dimension = 32
    centre = 7.5

    # Words whose vectors are remembered, some 600 bytes each; the others are made again.
    most_known = 50_000

    def __init__(self) -> None:
        self._known: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        vector = self._known.get(word)
        if vector is None:
            digest = hashlib.md5(word.encode("utf-8")).hexdigest()
            vector = np.array([int(digit, 16) for digit in digest]) - self.centre
            if len(self._known) < self.most_known:
                self._known[word] = vector
        return vector

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            words = text.lower().split()
            if words:
                out[row] = np.sum([self._word(word) for word in words], axis=0) / len(words)
        return out
