"""How long an alignment takes."""

from __future__ import annotations

import random
import time

from colinear.functions.kernels import affine_alignment


def alignment_seconds(size: int, free_ends: bool = False, seed: int = 0) -> tuple[float, float]:
    """(seconds, score) of aligning two random sequences of `size` bases."""
    r = random.Random(seed)
    target, query = ("".join(r.choice("ACGT") for _ in range(size)) for _ in range(2))
    began = time.perf_counter()
    score = affine_alignment(target, query, free_ends)
    return time.perf_counter() - began, score
