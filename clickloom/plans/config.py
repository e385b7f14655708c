"""Settings as frozen values; unknown names are errors."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


class _Settings:
    def update(self, **changes):
        """A copy with changes; a name that isn't a setting raises ``ValueError``."""
        known = {f.name for f in fields(self)}
        for name in changes:
            if name not in known:
                raise ValueError(f"unknown setting {name}")
        return replace(self, **changes)


@dataclass(frozen=True)
class DataSettings(_Settings):
    domains: tuple[str, ...] = ("All_Beauty", "Amazon_Fashion", "Digital_Music", "Gift_Cards", "Musical_Instruments")
    splits: tuple[str, ...] = ("train", "valid", "test")
    history: int = 3
    related: int = 5
    prompt_limit: int = 8000


@dataclass(frozen=True)
class ModelSettings(_Settings):
    kg_width: int = 128
    text_width: int = 768
    mode: str = "kg_text_fusion"
    fusion: str = "cross_attention_gated"
    head: str = "mlp_final"
    heads: int = 4
    hidden: int = 512


@dataclass(frozen=True)
class TrainSettings(_Settings):
    rate: float = 1e-5
    epochs: int = 50
    patience: int = 25
    loss: str = "bce_with_logits"
    optimiser: str = "adamw"
    scheduler: str = "cosine"
    tolerance: float = 1e-4
    decay: float = 1e-4
    clip: float = 1.0
    dropout: float = 0.3
    seed: int = 42


def validate(model: ModelSettings, train: TrainSettings) -> None:
    """Raise ``ValueError`` for a choice that isn't there or doesn't fit."""
    from clickloom.models.layers import FUSIONS, HEADS, MODES

    for value, known in ((model.fusion, FUSIONS), (model.head, HEADS), (model.mode, MODES), (train.loss, ("bce_with_logits", "focal", "mse", "smooth_l1")), (train.optimiser, ("adam", "adamw", "sgd")), (train.scheduler, ("cosine", "step", "plateau", "none"))):
        if value not in known:
            raise ValueError(f"unknown choice {value}; one of {', '.join(known)}")
    if not 0 <= train.dropout < 1:
        raise ValueError(f"a dropout rate lies in [0, 1), not at {train.dropout}")
    if model.heads < 1 or model.hidden % model.heads:
        raise ValueError(f"width {model.hidden} is not divisible by {model.heads} heads")
