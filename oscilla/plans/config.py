"""Settings of training and evaluation: checked once, immutable, readable from option files."""

from __future__ import annotations

import argparse
import shlex
from dataclasses import dataclass, field

FEATURES = ("bowav", "psd_autocorr", "bowav_psd_autocorr")
CLASSIFIERS = ("random_forest", "logistic", "ensembled_logistic")
FILTERS = (None, "original", "subj_to_subj", "normed-barycenter", "unnormed-barycenter")


@dataclass(frozen=True)
class EvalConfig:
    """What to evaluate: lengths in seconds, -1 for the whole series."""

    dataset: str
    feature: str = "bowav"
    classifier: str = "random_forest"
    cmmn_filter: str | None = None
    window_seconds: float = 1.5
    srate: float = 256.0
    train_seconds: float = 300.0
    validation_seconds: tuple[float, ...] = field(default=(300.0,))
    target_domain: bool = False

    def __post_init__(self) -> None:
        for value, allowed, what in ((self.feature, FEATURES, "feature"), (self.classifier, CLASSIFIERS, "classifier"), (self.cmmn_filter, FILTERS, "filter")):
            if value not in allowed:
                raise ValueError(f"no {what} {value!r}; one of {', '.join(map(str, allowed))}")
        if self.cmmn_filter == "subj_to_subj" and not self.target_domain:
            raise ValueError("subject to subject filters need a target domain")
        if self.classifier == "ensembled_logistic" and self.feature != "bowav_psd_autocorr":
            raise ValueError("an ensemble needs both features")
        if any(s != -1 and s <= 0 for s in (self.train_seconds, *self.validation_seconds)):
            raise ValueError("lengths are positive, or -1 for the whole series")

    @property
    def per_second(self) -> float:
        """Units of the features a second: windows for bags, samples for spectra."""
        return 1 / self.window_seconds if self.feature == "bowav" else self.srate

    @property
    def name(self) -> str:
        """The name of the results of these settings."""
        length = "None" if self.train_seconds == -1 else f"{self.train_seconds:g}"
        return f"{self.classifier}_{self.feature}_{length}_cmmn-{self.cmmn_filter}"


def rescaled(samples: int, old_rate: float, new_rate: float) -> int:
    """A length in samples at another sampling rate, rounded down."""
    return int(samples / old_rate * new_rate)


def read_options(text: str) -> list[str]:
    """The tokens of an option file: shell quoting, comments from # to the end of a line."""
    return shlex.split(text, comments=True)


#: Options of each kind of job, with what they take.
OPTIONS: dict[str, dict[str, dict]] = {
    "recording": {"--root": {"required": True}, "--dataset": {"required": True}, "--subjects": {"type": int, "nargs": "+"}, "--srate": {"type": float, "default": 256.0}, "--cmmn-filter": {"choices": [f for f in FILTERS if f]}},
    "windows": {"--window-seconds": {"type": float, "default": 1.5}, "--cap": {"type": int, "default": 10_000}},
    "codebook": {"--k": {"type": int, "default": 128}, "--centroid-seconds": {"type": float, "default": 1.0}, "--metric": {"choices": ["cosine", "euclidean"], "default": "cosine"}, "--init": {"choices": ["random", "random-energy", "k-means++"], "default": "random"}, "--n-init": {"type": int, "default": 1}, "--max-iter": {"type": int, "default": 100}, "--class": {"type": int, "default": 0, "dest": "label"}},
    "features": {"--feature": {"choices": FEATURES, "default": "bowav"}, "--train-seconds": {"type": float, "nargs": "+", "default": [300.0]}, "--validation-seconds": {"type": float, "nargs": "+", "default": [300.0]}},
    "classifier": {"--classifier": {"choices": CLASSIFIERS, "default": "random_forest"}, "--expert-weight": {"type": float, "nargs": "+", "default": [1.0]}, "--norm": {"choices": ["l1", "l2", "none"], "nargs": "+", "default": ["l2"]}, "--c": {"type": float, "nargs": "+", "default": [1.0]}, "--l1-ratio": {"type": float, "nargs": "+", "default": [0.0]}, "--min-rows": {"type": int, "nargs": "+", "default": [1]}},
    "job": {"--candidate": {"type": int}, "--split": {"type": int}, "--results": {"default": "results"}},
}
#: The groups of options that each kind of job reads.
JOBS = {
    "dictionary": ("recording", "windows", "codebook"), "filters": ("recording",), "assignments": ("recording", "windows", "codebook"),
    "search": ("recording", "windows", "features", "classifier", "job"), "refit": ("recording", "windows", "features", "classifier", "job"),
}


def job_parser(job: str) -> argparse.ArgumentParser:
    """Options of a kind of job; several option files and arguments can follow one another, the last one counts."""
    if job not in JOBS:
        raise ValueError(f"no job {job!r}; one of {', '.join(JOBS)}")
    options = argparse.ArgumentParser(description=job)
    for group in JOBS[job]:
        part = options.add_argument_group(group)
        for name, how in OPTIONS[group].items():
            part.add_argument(name, **how)
    return options


def grid_values(options: argparse.Namespace) -> dict[str, list]:
    """The values of a search's grid: what the classifier and the features take, by the names of ``search.fit_and_score``."""
    values = {"aggregate": ["count_pooling", "majority_vote"], "expert_weight": options.expert_weight, "train": options.train_seconds, "val": options.validation_seconds}
    if "bowav" in options.feature:
        values["norm"] = options.norm
    return values | ({"min_rows": options.min_rows} if options.classifier == "random_forest" else {"c": options.c, "l1_ratio": options.l1_ratio})


def parser() -> argparse.ArgumentParser:
    """Options of dictionary training and evaluation jobs."""
    options = argparse.ArgumentParser(description="train dictionaries and evaluate classifiers")
    options.add_argument("--dataset", required=True)
    options.add_argument("--feature", choices=FEATURES, default="bowav")
    options.add_argument("--classifier", choices=CLASSIFIERS, default="random_forest")
    options.add_argument("--cmmn-filter", choices=[f for f in FILTERS if f])
    options.add_argument("--train-seconds", type=float, default=300.0)
    options.add_argument("--validation-seconds", type=float, nargs="+", default=[300.0])
    options.add_argument("--target-domain", action="store_true")
    return options


def configured(tokens: list[str]) -> EvalConfig:
    found = vars(parser().parse_args(tokens))
    return EvalConfig(**found | {"validation_seconds": tuple(found["validation_seconds"])})
