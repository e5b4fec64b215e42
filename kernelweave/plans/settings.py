"""Settings of runs: a dataclass, and a reader for files of nested ``name: value`` lines."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from pathlib import Path

#: Kernels that see hyperedges as cliques; all others see hypergraphs.
ON_GRAPHS = ("graph_subtree", "graphlet_sampling", "graph_retgk", "graph_shortestpath", "graph_2wl", "graph_persistencewl", "graph_homo")


@dataclass(frozen=True)
class Settings:
    """``vectors`` is the path of precomputed features for the kernels that need them."""

    kernels: tuple[str, ...] = ("hypergraph_subtree", "hypergraph_hyedge")
    folds: int = 5
    seed: int | None = 2023
    c: float = 1.0
    degree_as_tag: bool = True
    normalise: bool = True
    learner: str = "svm"
    vectors: str | None = None


def parse(text: str) -> dict:
    """A nested dict of ``name: value`` lines by indentation; ``#`` starts a comment, ``[a, b]`` is a list."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip() or body.strip().startswith("-"):
            continue
        depth = len(body) - len(body.lstrip())
        name, _, value = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][name.strip()] = scalar(value.strip())
        else:
            inner: dict = {}
            stack[-1][1][name.strip()] = inner
            stack.append((depth, inner))
    return root


def scalar(value: str):
    if value.startswith("[") and value.endswith("]"):
        return [scalar(x.strip()) for x in value[1:-1].split(",") if x.strip()]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if value.lower() in ("null", "none", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip("\"'")


def load(path: str, **changes) -> Settings:
    """Settings from a file with ``seed``, ``data`` (n_fold, degree_as_tag) and ``model`` (name, normalize)."""
    found = parse(Path(path).read_text())
    data, model = found.get("data", {}), found.get("model", {})
    names = model.get("name", Settings.kernels)
    given = {
        "kernels": tuple(names) if isinstance(names, (list, tuple)) else (names,),
        "folds": data.get("n_fold", Settings.folds),
        "seed": found.get("seed", Settings.seed),
        "degree_as_tag": data.get("degree_as_tag", True),
        "normalise": model.get("normalize", True),
        "vectors": data.get("vectors"),
    }
    return replace(Settings(**given), **changes)


def logger(path: str | None = None, name: str = "kernelweave") -> logging.Logger:
    """A logger to the console and, if given, to a file."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for old in list(log.handlers):
        log.removeHandler(old)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
    return log
