"""Options of a run and the kinds of fields."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

KINDS = ("categorical", "binned-ip", "binned-port", "binned_integer", "timestamp", "int-exponential", "float-exponential")


@dataclass(frozen=True)
class FieldSpec:
    """How a column becomes codes. `bin` is a prefix, a bin size or a base, `threshold` the last unbinned port plus one."""

    kind: str
    bin: float = 0
    threshold: int = 1024
    diff_bin: float = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")


def load_fields(path: str) -> dict[str, FieldSpec]:
    """Field specs from a JSON object: name to kind, bin, threshold and diff_bin."""
    return {k: FieldSpec(**v) for k, v in json.loads(Path(path).read_text()).items()}


@dataclass
class RunConfig:
    """All options of a run, with their defaults."""

    dataset_name: str = "ton"
    is_cal_marginals: bool = True
    is_cal_depend: bool = True
    epsilon: float = 2.0
    depend_epsilon_ratio: float = 0.1
    marg_add_sensitivity: float = 1.0
    marg_select_sensitivity: float = 4.0
    noise_add_method: str = "A3"
    is_combine: bool = True
    non_negativity: str = "N3"
    consist_iterations: int = 501
    initialize_method: str = "singleton"
    update_method: str = "S5"
    append: bool = True
    sep_syn: bool = False
    update_rate_method: str = "U4"
    update_rate_initial: float = 1.0
    num_synthesize_records: int = 600_000
    update_iterations: int = 200
    dump_marginal: str | None = None
    is_syn_filtered: bool = False  # accepted, without effect
    pred_attr: str = "type"
    binning_method: str = "manual"  # accepted, without effect
    threshold: float = 20_000
    # beyond the options that a run has always had
    combine_cells: int = 5_000
    initial_marginals: tuple[tuple[str, ...], ...] = ()  # for marginal_manual; on the command line as a_b,c_d
    noise: str = "random"  # or "none", or "keyed" for tests only: a known seed is not private
    seed: int | None = None
    charge_recode: bool = True
    faithful: bool = False
    shards: int = 0  # 0: one for each 50,000 records


def str2bool(text: str | bool) -> bool:
    if isinstance(text, bool):
        return text
    if text.lower() in ("yes", "true", "t", "y", "1"):
        return True
    if text.lower() in ("no", "false", "f", "n", "0"):
        return False
    raise argparse.ArgumentTypeError("a boolean is needed")


def marginal_list(text: str) -> tuple[tuple[str, ...], ...]:
    """Marginals such as a_b,c_d."""
    return tuple(tuple(m.split("_")) for m in text.split(",") if m)


def parser() -> argparse.ArgumentParser:
    """A command line with one option for each field of RunConfig."""
    out = argparse.ArgumentParser(description=__doc__, add_help=False)
    for f in fields(RunConfig):
        kind = str2bool if isinstance(f.default, bool) else marginal_list if isinstance(f.default, tuple) else type(f.default) if f.default is not None else (int if f.name == "seed" else str)
        out.add_argument(f"--{f.name}", type=kind, default=f.default)
    return out


def from_args(args: list[str] | None = None) -> RunConfig:
    return RunConfig(**vars(parser().parse_args(args)))


def logger(name: str = "tabveil", level: int = logging.INFO) -> logging.Logger:
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s", level=level)
    return logging.getLogger(name)
