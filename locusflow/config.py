"""Parameters of a run and their reconciliation with those of a catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from locusflow.functions.translate import CODES


@dataclass(frozen=True)
class Config:
    """Domains are checked on construction; a value outside its domain raises ValueError."""

    bsr: float = 0.6
    translation_table: int = 11
    minimum_length: int = 201
    size_threshold: float | None = 0.2
    word_size: int = 5
    window_size: int = 5
    clustering_sim: float = 0.2
    representative_filter: float = 0.9
    intra_filter: float = 0.9

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(0 <= self.bsr <= 1, "bsr must be within 0 and 1")
        need(self.minimum_length >= 0, "minimum_length must not be negative")
        need(self.size_threshold is None or 0 <= self.size_threshold <= 1, "size_threshold must be within 0 and 1")
        need(self.translation_table in CODES, f"no genetic code {self.translation_table}")
        need(self.word_size == 5 and self.window_size == 5, "word_size and window_size are 5")
        need(self.clustering_sim == 0.2, "clustering_sim is 0.2")
        need(self.representative_filter == 0.9 and self.intra_filter == 0.9, "the filters are 0.9")


def reconcile(stored: dict[str, list], wanted: dict[str, object], force: bool = False) -> tuple[dict[str, object], dict[str, list]]:
    """(values to use, values to store): a wanted value that the catalogue never had needs ``force`` and is added to it."""
    use, keep = {}, {k: list(v) for k, v in stored.items()}
    for name, values in stored.items():
        value = wanted.get(name)
        use[name] = values[0] if value is None else value
        if value is not None and str(value) not in map(str, values):
            if not force:
                raise ValueError(f"{name}={value} differs from the catalogue's {values}")
            keep[name].append(value)
    return use | {k: v for k, v in wanted.items() if k not in stored and v is not None}, keep
