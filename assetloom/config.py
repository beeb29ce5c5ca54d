"""Engine settings, read from and written to JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

RULES = ("highest_resolution", "oldest_creation_date", "preferred_format", "preferred_directory", "smallest_file_size", "largest_file_size")


@dataclass(frozen=True)
class Config:
    dry_run: bool = True
    duplicates_dir: str = "duplicates"
    delete_duplicates: bool = False
    create_symlinks: bool = False
    max_distance: int = 6  # bits of a 64-bit hash; similarity_pct is the other way to say it
    similarity_pct: int | None = None
    max_depth: int | None = None
    process_unsupported_formats: bool = False
    excluded_directories: tuple[str, ...] = ()
    prioritization: tuple[str, ...] = ("highest_resolution", "largest_file_size", "oldest_creation_date")
    preferred_formats: tuple[str, ...] = ()
    preferred_directories: tuple[str, ...] = ()
    force_rescan: bool = False
    reinitialise_database: bool = False
    database_name: str = "hash_store"
    batch_size: int = 100
    threads: int = 0  # 0: as many as the cluster has
    log_level: str = "info"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if unknown := set(self.prioritization) - set(RULES):
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        if self.batch_size < 1 or self.max_distance < 0 or (self.max_depth is not None and self.max_depth < 0):
            raise ValueError("batch_size, max_distance and max_depth can't be negative")
        if self.similarity_pct is not None and not 0 <= self.similarity_pct <= 100:
            raise ValueError("similarity_pct lies between 0 and 100")

    def distance(self, bits: int = 64) -> int:
        """The threshold in bits for hashes of this length."""
        if self.similarity_pct is not None:
            return bits * (100 - self.similarity_pct) // 100
        return self.max_distance * (16 if bits == 1024 else 1)

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if "database_path" in raw:
            raw.setdefault("database_name", raw.pop("database_path"))
        names = {f.name for f in fields(cls)}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names and k != "extra"}
        return cls(**known, extra={k: v for k, v in raw.items() if k not in names})

    def save_to_file(self, path: str) -> None:
        raw = asdict(self)
        raw |= raw.pop("extra")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(raw, f, indent=2)
