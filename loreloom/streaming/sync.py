"""What follows a quiet spell: a function of the caller's, or a vault's git repository brought up to date."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class AfterQuiet:
    """Wraps a foreachBatch function: once batches have brought nothing for ``seconds``, ``call`` runs, once a spell."""

    def __init__(self, apply: Callable[[DataFrame, int], bool], call: Callable[[], object], seconds: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.apply, self.call, self.seconds, self.clock = apply, call, seconds, clock
        self.last: float | None = None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.apply(batch, epoch):
            self.last = self.clock()
        elif self.last is not None and self.clock() - self.last >= self.seconds:
            self.last = None
            self.call()


def git_sync(root: str, message: str = "Notes as of this sync", timeout: float = 120.0) -> str:
    """Commits what changed, then exchanges it with the remote, if there is one.

    Returns ``clean``, ``committed``, ``exchanged`` or ``conflict``; a conflict leaves the branch as it was.
    """
    git = lambda *args: subprocess.run(("git", "-C", root, *args), capture_output=True, text=True, timeout=timeout)  # noqa: E731, S603, S607
    if git("rev-parse", "--is-inside-work-tree").returncode:
        raise NotADirectoryError(f"no git repository: {root}")
    git("add", "-A").check_returncode()
    done = "clean"
    if git("diff", "--cached", "--quiet").returncode:
        git("commit", "-q", "-m", message).check_returncode()
        done = "committed"
    if git("rev-parse", "--abbrev-ref", "@{upstream}").returncode:
        return done
    if git("pull", "-q", "--rebase").returncode:
        git("rebase", "--abort")
        return "conflict"
    git("push", "-q").check_returncode()
    return "exchanged"
