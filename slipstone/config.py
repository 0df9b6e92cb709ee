"""Tunable parameters of the scored layer."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import vocab


@dataclass(frozen=True)
class ScoringConfig:
    """Weights, thresholds and blocking of layer 3.

    ``scope`` is the column that limits which earlier vouchers a voucher is compared with;
    ``exact_scope`` does the same for layer 2 (``None`` = all tenants).
    ``similarity`` picks the reference measure (``indel`` or ``sequence_matcher``).
    ``tile_rows`` is the block size above which a block is cut into tiles.
    """

    w_ref: float = vocab.DEFAULT_WEIGHTS["w_ref"]
    w_text: float = vocab.DEFAULT_WEIGHTS["w_text"]
    w_monto: float = vocab.DEFAULT_WEIGHTS["w_monto"]
    w_fecha: float = vocab.DEFAULT_WEIGHTS["w_fecha"]
    duplicate_at: float = vocab.DUPLICATE_AT
    suspect_at: float = vocab.SUSPECT_AT
    window_days: int = vocab.WINDOW_DAYS
    scope: str = "id_usuario"
    exact_scope: str | None = None
    similarity: str = "indel"
    tile_rows: int = 20_000
    limits: dict = field(default_factory=lambda: dict(vocab.PLAN_LIMITS))

    def with_weights(self, **weights: float) -> "ScoringConfig":
        return replace(self, **weights)
