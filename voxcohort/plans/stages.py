"""The run plan: which stages a request needs, in order, and what may be left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

@dataclass(frozen=True)
class Stage:
    """A step, what it reads and what it makes."""

    name: str
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    options: dict[str, object] = field(default_factory=dict, hash=False)


def root_of(dataset: str, explicit: dict[str, str], parent: str | None, exists: Callable[[str], bool]) -> str:
    """A dataset's folder: the one named for it, else the one below the common parent."""
    found = explicit.get(dataset) or (f"{parent.rstrip('/')}/{dataset}" if parent else None)
    if found is None:
        raise ValueError(f"no folder for {dataset}")
    if not exists(found):
        raise FileNotFoundError(found)
    return found


def plan(datasets: dict[str, bool], geometry_done: bool, force: bool = False) -> list[Stage]:
    """Geometry for datasets whose value says that they need it (unless its table is there), conversion of each, labels."""
    if not datasets:
        raise ValueError("no datasets")
    out = []
    if any(datasets.values()) and (force or not geometry_done):
        out += [Stage("measure", ("release",), ("measurements",)), Stage("solve", ("measurements",), ("geometry",))]
    for name, needs in datasets.items():
        out.append(Stage("convert", ("release", *(("geometry",) if needs else ())), ("cases", "manifest"), {"dataset": name}))
    return [*out, Stage("label", ("cases", "manifest"), ("lesions", "labels"))]


def explain(stages: list[Stage]) -> str:
    return "\n".join(f"{i}. {s.name}{''.join(f' {k}={v}' for k, v in s.options.items())}: {', '.join(s.needs)} -> {', '.join(s.makes)}" for i, s in enumerate(stages, 1))


def run(stages: list[Stage], actions: dict[str, Callable[[Stage], None]]) -> list[str]:
    """Run the stages in order; the first that fails ends the run."""
    done = []
    for stage in stages:
        actions[stage.name](stage)
        done.append(stage.name)
    return done
