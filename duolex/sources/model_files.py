"""Where a model-backed embedder finds its files, and whether it may ask the network. Called once per Python worker.

A snapshot is a folder as it is listed: names and sizes. Whether it suffices is asked of the set of names that have content."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, MutableMapping
from dataclasses import dataclass
from pathlib import Path

#: Short names of models; files that make a snapshot complete; switches that keep the library offline, and what turns them on.
SHORT_NAMES = {"bert": "bert-base-multilingual-cased", "xlmr": "xlm-roberta-base"}
CONFIG = "config.json"
WEIGHTS = ("model.safetensors", "pytorch_model.bin")
INDEX = ".index.json"
TOKENIZERS = ("sentencepiece.bpe.model", "spiece.model", "tokenizer.json", "vocab.txt", "vocab.json")
OFFLINE = ("HF_HUB_OFFLINE", "TRANSFORMERS_OFFLINE")
YES = ("1", "on", "true", "yes")
#: Variables that name the cache, the first that is set counts, and the folder below.
CACHES = (("HF_HUB_CACHE", "."), ("TRANSFORMERS_CACHE", "."), ("HF_HOME", "hub"))
HOME = ".cache/huggingface/hub"


@dataclass(frozen=True)
class Access:
    model_id: str
    offline: bool
    snapshot: Path | None

    @property
    def complete(self) -> bool:
        return self.snapshot is not None


def listed(folder: Path) -> dict[str, int]:
    """Sizes by name of all files below a folder, links followed; empty where there is none. A file that can't be read isn't listed."""
    out: dict[str, int] = {}
    for at, _, names in os.walk(folder, followlinks=True):
        for name in names:
            path = os.path.join(at, name)
            if os.path.exists(path):
                out[os.path.relpath(path, folder)] = os.path.getsize(path)
    return out


def parts(index: str) -> set[str]:
    """The files that the text of a weight index names; none if it isn't one."""
    try:
        named = json.loads(index)["weight_map"]
        return {str(x) for x in named.values()}
    except (ValueError, LookupError, TypeError, AttributeError):
        return set()


def missing(folder: Path) -> list[str]:
    """What a snapshot lacks: its configuration, weights (one file, or all parts that an index names), a tokenizer."""
    full = {name for name, size in listed(folder).items() if size}
    indexed = [parts((folder / f"{w}{INDEX}").read_text(encoding="utf-8", errors="replace")) for w in WEIGHTS if f"{w}{INDEX}" in full]
    has = {
        "configuration": CONFIG in full,
        "weights": not full.isdisjoint(WEIGHTS) or any(x and x <= full for x in indexed),
        "tokenizer": not full.isdisjoint(TOKENIZERS),
    }
    return [what for what, there in has.items() if not there]


def places(model_id: str, env: MutableMapping[str, str]) -> Iterable[Path]:
    """Folders that may hold the model, the best first: a folder of that name, then the cache's snapshots from the last name on."""
    yield Path(model_id).resolve()
    below = next((os.path.join(os.path.expanduser(env[name]), sub) for name, sub in CACHES if env.get(name)), os.path.join(Path.home(), HOME))
    kept = Path(below, "models--" + "--".join(model_id.split("/")), "snapshots")
    if kept.is_dir():
        yield from sorted((kept / x for x in os.listdir(kept)), reverse=True)


def model_access(model: str, policy: str = "if-missing", env: MutableMapping[str, str] | None = None) -> Access:
    """`always` asks the network, `offline` never does, `if-missing` does unless a snapshot is complete or a switch forbids it. The
    switches in env are set or removed accordingly."""
    env = os.environ if env is None else env
    model_id = SHORT_NAMES.get(model, model)
    snapshot = next((x for x in places(model_id, env) if x.is_dir() and not missing(x)), None)
    offline = policy == "offline"
    if policy == "if-missing":
        offline = snapshot is not None or any(env.get(n, "").strip().lower() in YES for n in OFFLINE)
    for n in OFFLINE:
        env.pop(n, None)
    if offline:
        env.update(dict.fromkeys(OFFLINE, "1"))
    return Access(model_id, offline, snapshot)
