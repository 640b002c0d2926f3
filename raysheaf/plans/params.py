"""Parameter files: YAML sections to dataclasses, with overrides and checks."""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..functions import units as U


@dataclass
class Sweep:
    directions: Any
    max_timestep: str | float
    num_timestep_levels: int = 1
    significant_rate_threshold: str | float = 0.0
    timestep_safety_factor: float = 0.1
    chemistry_timestep_safety_factor: float = 0.1
    prevent_cooling: bool = True
    periodic: bool = False
    rotate_directions: bool = False
    check_deadlock: bool = True


@dataclass
class Output:
    time_between_snapshots: str | float
    time_first_snapshot: str | float | None = None
    output_dir: str = "output"
    fields: Any = "all"
    num_output_files: int = 1
    snapshot_padding: int = 3
    handle_existing_output: str = "panic"
    used_parameters_filename: str = "parameters.yml"
    performance_data_filename: str = "performance.yml"


@dataclass
class Input:
    paths: list = field(default_factory=list)


@dataclass
class Postprocess:
    sources: Any
    grid: Any = "construct"
    initial_fraction_ionized_hydrogen: float | None = None
    escape_fraction: float = 1.0
    remap_from: str | None = None


@dataclass
class CosmologySection:
    a: float = 1.0
    h: float = 1.0
    params: dict | None = None


@dataclass
class Simulation:
    final_time: str | float | None = None


@dataclass
class Box:
    size: Any = None
    min: Any = None
    max: Any = None


SECTIONS = {"sweep": Sweep, "output": Output, "input": Input, "postprocess": Postprocess, "cosmology": CosmologySection, "simulation": Simulation, "box": Box}
IGNORED = ("visualization",)


class Parameters:
    """Sections of a parameter file. A section is read once it is asked for; ``unused`` names those that never were."""

    def __init__(self, text: str = "{}"):
        self.contents: dict = yaml.safe_load(text) or {}
        self.read: dict[str, Any] = {}

    def override(self, spec: str) -> None:
        """``section/key/...:value``, with exactly one colon; the value is YAML."""
        path, colon, value = spec.partition(":")
        if not colon or ":" in value:
            raise ValueError(f"override {spec!r} must have exactly one colon")
        node = self.contents
        *parents, last = path.split("/")
        for key in parents:
            node = node.setdefault(key, {})
            if not isinstance(node, dict):
                raise ValueError(f"{key} in {spec!r} is not a section")
        node[last] = yaml.safe_load(value)

    def section(self, name: str) -> Any:
        """The section's dataclass. Unknown and missing fields raise; a section asked for again is the same object."""
        if name not in self.read:
            kind, given = SECTIONS[name], self.contents.get(name) or {}
            known = {f.name: f for f in dataclasses.fields(kind)}
            if unknown := sorted(set(given) - set(known)):
                raise ValueError(f"unknown fields in section {name}: {unknown}")
            required = [n for n, f in known.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
            if missing := [n for n in required if n not in given]:
                raise ValueError(f"missing fields in section {name}: {missing}")
            self.read[name] = kind(**given)
        return self.read[name]

    def set(self, name: str, value: Any) -> None:
        if name in self.read or name in self.contents:
            raise ValueError(f"section {name} is already present")
        self.read[name] = value

    def unused(self) -> list[str]:
        return sorted(set(self.contents) - set(self.read) - set(IGNORED))

    def check_unused(self) -> None:
        if names := self.unused():
            raise ValueError(f"sections that nothing uses: {names}")

    def as_yaml(self) -> str:
        """The parameters in use, defaults included."""
        return yaml.safe_dump({k: dataclasses.asdict(v) for k, v in sorted(self.read.items())})


def command_line(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("raysheaf")
    parser.add_argument("parameters")
    parser.add_argument("overrides", nargs="*", help="section/key:value")
    parser.add_argument("-v", "--verbose", action="count", default=0)
    parser.add_argument("--master", default="local[*]")
    return parser.parse_args(argv)


def si(value: str | float | None, expect: U.Dimension, a: float = 1.0, h: float = 1.0) -> float | None:
    """A parameter with a unit in SI, its cosmological factors taken out; plain numbers are SI."""
    if value is None or isinstance(value, (int, float)):
        return value
    found = U.parse_quantity(value).physical(a, h)
    if found.dimension != expect:
        raise ValueError(f"{value!r} has dimension {found.dimension}, expected {expect}")
    return found.value
