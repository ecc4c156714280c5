"""Uploads, results and their index: tables beside Parquet or MAT files in a data folder."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path

from ..functions.text import result_key  # noqa: F401
from . import formats


def safe_name(name: str) -> str:
    import re

    return re.sub(r'[<>:"/\\|?*\s]+', "_", name.strip()).strip("._") or "file"


@dataclass
class Result:
    result_id: str
    path: str
    source_path: str
    result_key: str
    outputs: dict[str, dict] = field(default_factory=dict)
    file_id: str | None = None


class Registry:
    """Uploads and results in a folder; each index is written to a new file and then renamed."""

    def __init__(self, root: str, allow_paths: bool = False):
        self.root, self.allow_paths = Path(root), allow_paths
        for name in ("uploads", "runs"):
            (self.root / name).mkdir(parents=True, exist_ok=True)

    def _index(self, name: str) -> dict:
        path = self.root / f"{name}.json"
        return json.loads(path.read_text()) if path.exists() else {}

    def _save(self, name: str, index: dict) -> None:
        fresh = self.root / f".{name}.{uuid.uuid4().hex}"
        fresh.write_text(json.dumps(index, ensure_ascii=False, sort_keys=True))
        os.replace(fresh, self.root / f"{name}.json")

    def run_folder(self, kind: str, now: datetime | None = None) -> str:
        name = f"{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}_{safe_name(kind)}"
        n = 1
        while True:
            path = self.root / "runs" / (name if n == 1 else f"{name}_{n}")
            try:
                path.mkdir()
                return str(path)
            except FileExistsError:
                n += 1

    def register_upload(self, path: str, name: str | None = None) -> dict:
        source = Path(path)
        if source.suffix.lower() != ".mat":
            raise ValueError("Only .mat files are supported.")
        content = source.read_bytes()
        file_id = uuid.uuid4().hex
        target = self.root / "uploads" / file_id / safe_name(name or source.name)
        target.parent.mkdir(parents=True)
        target.write_bytes(content)
        entry = {"file_id": file_id, "path": str(target), "variables": formats.inspect_mat(content), "created_at": datetime.now().isoformat(timespec="seconds")}
        self._save("uploads", self._index("uploads") | {file_id: entry})
        return entry

    def resolve(self, file_id: str | None = None, path: str | None = None) -> tuple[str | None, str]:
        if file_id:
            entry = self._index("uploads").get(file_id)
            if entry is None:
                raise KeyError(f"unknown file_id: {file_id}")
            return file_id, entry["path"]
        if path and self.allow_paths:
            return None, path
        raise ValueError("Use the file_id of an upload; local paths are disabled.")

    def save(self, run: str, source_path: str, key: str, arrays: dict, file_id: str | None = None) -> Result:
        """Arrays of one result as a MAT file with a sidecar, and its row in the index."""
        path = Path(run) / f"{Path(run).name}_{safe_name(Path(source_path).stem)}_{safe_name(key)}.mat"
        path.write_bytes(formats.write_mat(arrays))
        made = Result(uuid.uuid4().hex, str(path), source_path, key, {n: {"shape": list(a.shape)} for n, a in arrays.items()}, file_id)
        path.with_suffix(".json").write_text(json.dumps(asdict(made)))
        self._save("results", self._index("results") | {made.result_id: asdict(made)})
        return made

    def get(self, result_id: str) -> Result:
        return Result(**self._index("results")[result_id])

    def recover(self, ref: dict) -> Result:
        """The index row of a result that the index has lost, from its sidecar or file; only below the runs folder."""
        path = Path(ref["path"]).resolve()
        if not path.is_relative_to((self.root / "runs").resolve()):
            raise ValueError("the path is outside of the runs folder")
        side = path.with_suffix(".json")
        if side.exists():
            made = Result(**json.loads(side.read_text()))
        else:
            arrays = formats.read_mat(path.read_bytes())
            made = Result(ref.get("result_id") or uuid.uuid4().hex, str(path), ref.get("source_path", ""), ref.get("result_key", ""), {n: {"shape": list(a.shape)} for n, a in arrays.items()})
        self._save("results", self._index("results") | {made.result_id: asdict(made)})
        return made

    def array(self, result_id: str, name: str = "strain") -> dict:
        """Shape, finite extent and rows of a result's array (NaN as 0)."""
        import numpy as np

        value = formats.read_mat(Path(self.get(result_id).path).read_bytes())[name]
        fine = value[np.isfinite(value)]
        return {"shape": list(value.shape), "min": float(fine.min()) if fine.size else 0.0, "max": float(fine.max()) if fine.size else 0.0, "values": np.nan_to_num(value).tolist()}
