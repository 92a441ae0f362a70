"""Configuration trees: maps that inherit from one another, and the experiments that they name."""

from __future__ import annotations

import json
import os

from sparkrank.operators.models import Experiment

#: Keys under ``data`` and ``output`` that hold paths, relative to the configuration's folder.
PATHS = (("data", "train_path"), ("data", "test_path"), ("data", "sample_path"), ("data", "parent_path"), ("output", "directory"))


def merged(base: dict, over: dict) -> dict:
    """Maps merge key by key; anything else, lists included, is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parsed(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: reading YAML needs the yaml package; JSON always works") from e
        tree = yaml.safe_load(text)
    else:
        tree = json.loads(text)
    if not isinstance(tree, dict):
        raise ValueError(f"{path}: a configuration is a map")
    return tree


def load(path: str, _seen: tuple[str, ...] = ()) -> dict:
    """The tree at ``path`` over the one that it ``extends`` (relative to itself), and so on."""
    path = os.path.abspath(path)
    if path in _seen:
        raise ValueError("configurations extend each other: " + " > ".join((*_seen, path)))
    tree = _parsed(path)
    parent = tree.pop("extends", None)
    if parent is not None and not isinstance(parent, str):
        raise ValueError(f"{path}: extends takes one path")
    if parent:
        tree = merged(load(os.path.join(os.path.dirname(path), parent), (*_seen, path)), tree)
    return tree if _seen else located(tree, os.path.dirname(path))


def located(tree: dict, root: str) -> dict:
    for section, key in PATHS:
        value = tree.get(section, {}).get(key)
        if value and "://" not in value:
            tree[section][key] = os.path.normpath(os.path.join(root, value))
    return tree


def default_view(tree: dict) -> str:
    """What ``features`` asks for; switching engineered columns off wins over a default view that has them."""
    features = tree.get("features", {})
    view = features.get("default_view", "engineered")
    return view if features.get("engineered", True) else {"engineered": "raw", "engineered_artifact": "artifact", "engineered_artifact_cat": "artifact_cat", "engineered_parent": "raw_parent"}.get(view, view)


def experiments(tree: dict, asked: list[str] | None = None) -> list[Experiment]:
    """Those asked for by name (a name that isn't configured is a model's), else all that are configured, else one
    per model listed."""
    training = tree.get("training", {})
    known = {e["name"]: e for e in training.get("experiments") or [] if e.get("name")}
    if len(known) != len(training.get("experiments") or []):
        raise ValueError("experiments need names, each its own")
    names = asked or list(known) or training.get("models", [])
    if len(set(names)) != len(names):
        raise ValueError(f"experiments are named twice: {names}")
    out = []
    for n in names:
        e = known.get(n, {})
        model = e.get("model", n)
        out.append(Experiment(n, model, e.get("view", default_view(tree)), tuple(e.get("seeds", training.get("seeds", [42]))), merged(tree.get("models", {}).get(model, {}), e.get("params", {}))))
    return out
