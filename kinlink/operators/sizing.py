"""How much memory an index of dense vectors takes, and over how many holders it has to be dealt. Plain formulas, for planning."""

from __future__ import annotations

#: Megabytes that a holder needs besides its vectors, and vectors that are added at a time.
OVERHEAD_MB = 450.0
ADDED = 500_000


def index_mb(vectors: int, dimensions: int) -> float:
    """Megabytes of an index of 32-bit vectors on one holder."""
    return vectors * dimensions * 4 / (1 << 20) + OVERHEAD_MB


def shard_count(vectors: int, dimensions: int, budget: int, most: int, added: int = ADDED) -> int:
    """The least number of holders, `most` at the utmost, on which a shard of 16-bit vectors fits the budget of bytes while its
    buffer doubles; `most` if none does."""
    size = 2 * dimensions
    return next((n for n in range(1, most + 1) if (2 * -(-vectors // n) - added) * size <= budget), most)
