"""Batches of Python stages."""

from __future__ import annotations

import functools


def nonempty(stage):
    """A stage (a generator of frames) without the frames that have no rows, whose column types nobody can tell."""

    @functools.wraps(stage)
    def run(*args, **kwargs):
        for frame in stage(*args, **kwargs):
            if len(frame):
                yield frame

    return run
