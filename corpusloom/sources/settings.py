"""Run settings: defaults, then a sectioned file, then what was given explicitly."""

from __future__ import annotations

from dataclasses import fields, make_dataclass, replace

# Sections, names and defaults. Paths and project names have none.
SECTIONS = ("model", "training", "data", "checkpointing", "logging")
RENAMED = {"model_dim": "dim", "data_paths": "paths"}
DEFAULTS = {
    "paths": (),
    "tokenizer_path": None,
    "max_seq_len": 512,
    "val_fraction": 0.005,
    "dim": 512,
    "n_layers": 8,
    "n_heads": 8,
    "n_kv_heads": 4,
    "vocab_size": 32_000,
    "use_flash_attn": False,
    "rope_scaling_factor": 1.0,
    "sliding_window": None,
    "batch_size": 8,
    "grad_accumulation_steps": 4,
    "learning_rate": 3e-4,
    "min_lr": 3e-5,
    "warmup_steps": 200,
    "max_steps": 10_000,
    "weight_decay": 0.1,
    "grad_clip": 1.0,
    "dropout": 0.1,
    "label_smoothing": 0.1,
    "checkpoint_dir": "checkpoints",
    "save_every": 500,
    "keep_best_n": 3,
    "log_every": 50,
    "eval_every": 500,
    "device": "auto",
    "use_amp": True,
    "seed": 42,
    "num_workers": 0,
    "use_wandb": False,
    "wandb_project": None,
    "wandb_run_name": None,
    "experiment_name": "default",
}

RunSettings = make_dataclass("RunSettings", [(name, object, value) for name, value in DEFAULTS.items()], frozen=True)


def effective_batch_size(s: RunSettings) -> int:
    return s.batch_size * s.grad_accumulation_steps


def flattened(sections: dict, renames: dict[str, str] | None = None) -> dict:
    """Values of all sections in order, under their settings' names; what is no setting is left out."""
    renames, known, out = RENAMED | (renames or {}), {f.name for f in fields(RunSettings)}, {}
    for section in SECTIONS:
        for key, value in (sections.get(section) or {}).items():
            name = renames.get(key, key)
            if name in known:
                out[name] = tuple(value) if isinstance(value, list) else value
    return out


def resolved(sections: dict | None = None, explicit: dict | None = None, renames: dict[str, str] | None = None) -> RunSettings:
    """Settings of parsed ``sections``, overridden by ``explicit`` values that are not None."""
    given = {k: v for k, v in (explicit or {}).items() if v is not None}
    return replace(RunSettings(), **flattened(sections or {}, renames) | given)


def load_yaml(path: str, explicit: dict | None = None, renames: dict[str, str] | None = None) -> RunSettings:
    """Settings from a YAML file, where a YAML library is installed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; pass parsed sections to resolved()") from e
    with open(path, encoding="utf-8") as f:
        return resolved(yaml.safe_load(f) or {}, explicit, renames)
