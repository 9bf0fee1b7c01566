"""Named steps run one after the other, with a callback on how far they are."""

from collections.abc import Callable, Iterable
from typing import Any

#: (step, its number from 1, number of all steps, 'started' or 'done')
Progress = Callable[[str, int, int, str], None]


def run_steps(steps: Iterable[tuple[str, Callable[[dict[str, Any]], Any]]], progress: Progress | None = None) -> dict[str, Any]:
    """The results of the steps by name; each step is given those before it. A callback that fails stops nothing."""
    steps = list(steps)
    done: dict[str, Any] = {}

    def tell(name: str, i: int, state: str) -> None:
        if progress is not None:
            try:
                progress(name, i, len(steps), state)
            except Exception:  # noqa: BLE001  (who listens is no part of the work)
                pass

    for i, (name, step) in enumerate(steps, 1):
        tell(name, i, "started")
        done[name] = step(done)
        tell(name, i, "done")
    return done
