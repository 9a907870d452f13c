"""Settings: flags from a file of settings, the language model of a reader, and when it is worth training anew."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

#: A key of the file that is no flag.
NO_FLAG = "dynamic"
#: Samples from which on training is worth while.
ENOUGH = 50


def with_config(argv: list[str], config: str) -> list[str]:
    """argv with the flags of a JSON object; what argv has already wins. True is a flag alone; false and null are none.

    Text that is no JSON object changes nothing.
    """
    try:
        settings = json.loads(config)
    except ValueError:
        return list(argv)
    if not isinstance(settings, dict):
        return list(argv)
    given, more = set(argv), []
    for name, value in settings.items():
        flag = "--" + name.replace("_", "-")
        if name == NO_FLAG or flag in given or value is None or value is False:
            continue
        more += [flag] if value is True else [flag, str(value)]
    return argv[:1] + more + argv[1:]


def flag_value(argv: list[str], flag: str, kind: type = str):
    """The value after flag, None without the flag. A value that is missing, another flag or not of its kind is an error, no default."""
    if flag not in argv:
        return None
    rest = argv[argv.index(flag) + 1 :]
    if not rest or rest[0].startswith("--"):
        raise ValueError(f"{flag} needs a value")
    try:
        return kind(rest[0])
    except ValueError as e:
        raise ValueError(f"{flag} needs a value of kind {kind.__name__}, not {rest[0]!r}") from e


def reader_language(installed: Iterable[str], base: str = "ukr") -> str | None:
    """The language data that a reader uses: a trained one before the best before the plain one; None without any."""
    there = set(installed)
    return next((x for x in (f"{base}_custom", f"{base}_best", base) if x in there), None)


def model_choice(installed: Iterable[str], wanted: Iterable[str]) -> str | None:
    """The first installed language model by the order of wanted prefixes; None without one."""
    there = list(installed)
    return next((m for w in wanted for m in there if m.startswith(w)), None)


@dataclass(frozen=True)
class Trigger:
    """Whether a reader is trained anew: there are new samples, enough in all, and something to train with."""

    new: int
    total: int
    script: bool

    @property
    def fires(self) -> bool:
        return self.new > 0 and self.total >= ENOUGH and self.script
