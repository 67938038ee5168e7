"""Scopes: cached tables that end with a block, callbacks, and switching gradients off."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

_recording: ContextVar[bool] = ContextVar("recording", default=True)
_frames: ContextVar[tuple] = ContextVar("frames", default=())


def recording() -> bool:
    return _recording.get()


@contextmanager
def no_grad():
    """Operations inside record no graph; nests."""
    token = _recording.set(False)
    try:
        yield
    finally:
        _recording.reset(token)


class Frame:
    """Tables cached inside a ``with`` block are dropped at its end, or back to a mark; callbacks run last in, first out."""

    def __init__(self) -> None:
        self._stack: list[tuple[Callable, object]] = []

    def __enter__(self) -> Frame:
        self._token = _frames.set((*_frames.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _frames.reset(self._token)
        self.rollback(0)

    def cache(self, df: DataFrame) -> DataFrame:
        df = df.persist()
        self.push(lambda d: d.unpersist(), df)
        return df

    def push(self, call: Callable, argument: object) -> None:
        self._stack.append((call, argument))

    def cancel(self, argument: object) -> None:
        """Forget the latest callback with this argument; nothing happens if there is none."""
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][1] is argument:
                del self._stack[i]
                return

    def mark(self) -> int:
        return len(self._stack)

    def rollback(self, mark: int) -> None:
        while len(self._stack) > mark:
            call, argument = self._stack.pop()
            call(argument)


def current_frame() -> Frame | None:
    frames = _frames.get()
    return frames[-1] if frames else None
