"""Settings of a run: defaults, JSON files, command-line flags, checks."""

from __future__ import annotations

import argparse
import json
import warnings
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """All settings, under the names they have in configuration files.

    The last group is accepted so that existing files load, but has no effect here: sketches
    only screen and take their sizes from the data, and Spark manages sorting and memory.
    """

    ReadFileName: str = ""
    GeneFileName: str = ""
    GeneIdFileName: str = ""
    ResultsFileName: str = "results.txt"
    Windows: tuple[int, ...] = ()
    WindowWidth: int = 0
    PMatch: float = 1.0
    MinDinuc: int = 0
    MinReadLength: int = 0
    MaxReadLength: int = 0
    MaxMatches: int = 1_000_000
    MatchMode: str = "best"
    MMTol: int = 0
    LogDir: str = ""
    TempDir: str = ""
    NoCleanTemp: bool = False

    BloomSize: int = field(default=4_000_000_000, metadata={"physical": True})
    NumHash: int = field(default=20, metadata={"physical": True})
    MaxConfirmProcs: int = field(default=3, metadata={"physical": True})
    SortPar: int = field(default=8, metadata={"physical": True})
    SortMem: str = field(default="50%", metadata={"physical": True})
    SortTemp: str = field(default="", metadata={"physical": True})
    CPUProfile: bool = field(default=False, metadata={"physical": True})

    def check(self, files: bool = True) -> Config:
        """This configuration, if it can run; ValueError otherwise."""
        wanted = ["Windows", "WindowWidth", "MaxReadLength"] + ["ReadFileName", "GeneFileName"] * files
        if missing := [n for n in wanted if not getattr(self, n)]:
            raise ValueError(f"required settings are missing: {', '.join(missing)}")
        if any(w < 0 for w in self.Windows) or self.WindowWidth < 1 or self.MaxReadLength < 1:
            raise ValueError("windows, their width and read lengths cannot be negative")
        if not 0 <= self.PMatch <= 1:
            raise ValueError("PMatch is a proportion between 0 and 1")
        if min(self.MinDinuc, self.MinReadLength, self.MMTol) < 0 or self.MaxMatches < 1:
            raise ValueError("MinDinuc, MinReadLength and MMTol cannot be negative, MaxMatches has to be positive")
        if files and not self.ReadFileName.endswith(".fastq"):
            warnings.warn(f"{self.ReadFileName} may not be a fastq file", stacklevel=2)
        return self

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self)))


def _kept(values: dict) -> dict:
    """Zero, empty and missing values never override anything."""
    return {k: tuple(v) if k == "Windows" else v for k, v in values.items() if v}


def from_json(path: str | Path) -> Config:
    """A flat JSON object; unknown names are ignored, as are zero and empty values."""
    known = {f.name for f in fields(Config)}
    return Config(**_kept({k: v for k, v in json.loads(Path(path).read_text()).items() if k in known}))


def from_args(argv: Sequence[str]) -> Config:
    """Flags, with one dash or two, over a JSON file named by ConfigFileName over the defaults.

    A flag overrides the file only if it is neither zero nor empty.
    """
    parser = argparse.ArgumentParser(prog="seqjoin", allow_abbrev=False)
    parser.add_argument("--ConfigFileName", "-ConfigFileName", default="")
    for f in fields(Config):
        names = (f"--{f.name}", f"-{f.name}")
        if f.name == "Windows":
            parser.add_argument(*names, type=lambda text: [int(x) for x in text.split(",")], default=[])
        elif isinstance(f.default, bool):
            parser.add_argument(*names, action="store_true")
        else:
            parser.add_argument(*names, type=type(f.default), default=None)
    given = vars(parser.parse_args(list(argv)))
    base = from_json(name) if (name := given.pop("ConfigFileName")) else Config()
    return replace(base, **_kept(given))
