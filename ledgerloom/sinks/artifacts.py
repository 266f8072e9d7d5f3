"""A set of small output files with a manifest of their sizes and hashes; reruns give the same bytes."""

from __future__ import annotations

import hashlib
from pathlib import Path

from ledgerloom.sinks.canonical import pretty


def entry(data: bytes) -> dict[str, object]:
    return {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def write_artifacts(folder: str | Path, outputs: dict[str, str], inputs: dict[str, str | Path]) -> dict[str, object]:
    """Write outputs (name -> text) and manifest.json over them and the inputs; no time or absolute path is written."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    for name, text in outputs.items():
        (target / name).write_bytes(text.encode())
    manifest = {
        "schema_version": "artifact-manifest/1",
        "inputs": {name: entry(Path(path).read_bytes()) for name, path in inputs.items()},
        "outputs": {name: entry(text.encode()) for name, text in outputs.items()},
    }
    (target / "manifest.json").write_text(pretty(manifest))
    return manifest


def verify_artifacts(folder: str | Path, manifest: dict) -> list[str]:
    """Names of outputs that are missing or differ."""
    wrong = []
    for name, stated in manifest["outputs"].items():
        path = Path(folder) / name
        if not path.is_file() or entry(path.read_bytes()) != stated:
            wrong.append(name)
    return wrong
