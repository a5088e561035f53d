"""Run configuration: a base mapping and variants laid over it by dotted paths."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

#: Fixed values of the record schema: window, baseline, smoothing, peaks, substrate and text format.
BASE: dict[str, Any] = {
    "schema": "v1.2",
    "window": [500.0, 1750.0],
    "grid_step": 1.0,
    "baseline": {"method": "als", "lam": 100000.0, "p": 0.01, "niter": 10},
    "smooth": {"window_cm": 9, "polyorder": 3},
    "sim_extra_fwhm": 0.0,
    "sim_freq_scale": 1.0,
    "peaklist": {"source_rel_height": 0.7, "source_floor": 0.1},
    "dft": {"scale": 0.98, "fwhm": 10.0},
    "substrate": {
        "mode": "reference_norm",
        "pair_by": "condition_mean",
        "fit_regions": [[600, 635], [665, 690], [745, 765], [812, 845], [870, 895]],
        "tol_cm": 3.5,
        "max_shift_cm": 3.0,
        "catalogue_min_prominence": 0.10,
        "mask_after_subtract": False,
        "reference_norm": {
            "ref_cm": 829.0, "ref_tol": 4.0, "ref_min_rel_prominence": 0.02, "align_axis": False,
            "cb_regions": [[745, 765], [812, 845], [870, 895]], "match_tol_cm": 5.0, "keep_min_excess": 0.10, "keep_min_ratio": 1.5,
            "rescale_to_max_after_discard": False,
        },
        "generic_cb": {"path": None, "height": "p90", "min_corr": 0.90},
    },
    "peaks": {"min_prominence": 0.03, "noise_k": 4.0, "min_height": 0.05, "min_width_cm": 5.0, "min_distance_cm": 4.0, "width_rel_height": 0.5, "max_peaks": 40},
    "serialise": {"pos_decimals": 0, "int_decimals": 2, "width_decimals": 0, "field_sep": " ", "peak_sep": " | "},
    "prompt_template": "Peak list (position, relative intensity, FWHM):\n{text}\nWhich molecule produced this spectrum?",
    "split": {"group_by": "strip_replicate", "test_fraction": 0.2, "seed": 42},
    "max_seq_length": 2048,
    "answer_token_reserve": 32,
}

_SHIFTED = {"window": [510.0, 1800.0], "substrate.reference_norm.ref_tol": 8.0, "substrate.reference_norm.align_axis": True, "substrate.generic_cb.path": None}
_MATCHED = {"sim_extra_fwhm": 13.0, "substrate.reference_norm.rescale_to_max_after_discard": True}

#: Fixed values of the dataset variants, as dotted paths.
VARIANTS: dict[str, dict[str, Any]] = {
    "native": {},
    "matched": _MATCHED,
    "wide": {"window": [500.0, 1800.0]},
    "v2": _SHIFTED,
    "v2m": _SHIFTED | _MATCHED,
    "v2mf": _SHIFTED | _MATCHED | {"sim_freq_scale": 1.0134},
}


def overlay(base: dict, changes: dict[str, Any], name: str | None = None) -> dict:
    """A deep copy of ``base`` with dotted paths set; a missing parent is a KeyError. ``name`` is appended to the schema."""
    out = copy.deepcopy(base)
    for path, value in changes.items():
        *parents, leaf = path.split(".")
        node = out
        for key in parents:
            node = node[key]
        node[leaf] = copy.deepcopy(value)
    if name and name != "native":
        out["variant"], out["schema"] = name, f"{out['schema']}-{name}"
    else:
        out["variant"] = "native"
    return out


def variant(name: str | None = None, base: dict | None = None) -> dict:
    """The configuration of a variant; an unknown one is a ValueError."""
    known = (base or BASE).get("variants", VARIANTS)
    if name and name not in known:
        raise ValueError(f"unknown variant {name!r}; there are {', '.join(sorted(known))}")
    return overlay(base or BASE, known.get(name or "native", {}), name)


def load(path: str | Path, name: str | None = None) -> dict:
    """Read a YAML file and apply a variant; the file's own ``variants`` win over the built-in ones."""
    import yaml

    return variant(name, yaml.safe_load(Path(path).read_text()))


def data_dir(name: str | None, root: str = "data/records") -> str:
    """Where a variant's tables lie: a partition directory."""
    return f"{root}/variant={name or 'native'}"
