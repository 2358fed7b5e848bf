"""Documents taken and made piece by piece, so that none is held whole: JSON tokens from chunks, spools on disk, features in walking order."""

from __future__ import annotations

import codecs
import json
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator
from typing import Any

from .base import Layer, place

_SPACE = re.compile(r"[ \t\n\r]*")
_DECODE = json.JSONDecoder().raw_decode
#: A longer piece of text is read ahead when a value isn't complete.
AHEAD = 1 << 20
#: What is cut off may be this far before the end: an escape or a literal.
_CUT = 16


class Json:
    """JSON text in chunks of bytes, taken token by token. Members and elements come one at a time; whoever iterates takes their value."""

    def __init__(self, chunks: Iterable[bytes]):
        self._chunks, self._utf8 = iter(chunks), codecs.getincrementaldecoder("utf-8-sig")()
        self._text, self._from, self._at, self._done = "", 0, 0, False

    def _more(self) -> bool:
        """As much text again as is left, so that a large value is not tried too often."""
        left = self._text[self._at :]
        held, size = [left], 0
        while not self._done and size < max(AHEAD, len(left)):
            chunk = next(self._chunks, None)
            self._done = chunk is None
            held.append(self._utf8.decode(chunk or b"", self._done))
            size += len(held[-1])
        self._text, self._at = "".join(held), 0
        return size > 0

    def peek(self) -> str:
        """The first character of the next token, empty at the end."""
        while True:
            self._at = _SPACE.match(self._text, self._at).end()
            if self._at < len(self._text):
                return self._text[self._at]
            if not self._more():
                return ""

    def _expect(self, c: str) -> None:
        if self.peek() != c:
            raise ValueError(f"{c!r} expected, found {self.peek() or 'the end'!r}")
        self._at += 1

    def _apart(self, close: str, first: bool) -> bool:
        """Whether another member or element follows."""
        if self.peek() == close and first:
            self._at += 1
            return False
        if first:
            return True
        if self.peek() == close:
            self._at += 1
            return False
        self._expect(",")
        return True

    def text(self) -> str:
        """The next value as it stands."""
        return self.pair()[1]

    def pair(self) -> tuple[Any, str]:
        """The next value, and as it stands."""
        v = self.value()
        return v, self._text[self._from : self._at]

    def value(self) -> Any:
        self.peek()
        while True:
            try:
                v, end = _DECODE(self._text, self._at)
            except json.JSONDecodeError as e:
                if self._done or not (e.msg.startswith("Unterminated") or e.pos > len(self._text) - _CUT) or not self._more():
                    raise
                continue
            if end < len(self._text) or self._text[self._at] in '{["' or not self._more():  # a number may go on
                self._from, self._at = self._at, end
                return v

    def members(self) -> Iterator[str]:
        self._expect("{")
        first = True
        while self._apart("}", first):
            first = False
            if self.peek() != '"':
                raise ValueError("a key expected")
            key = self.value()
            self._expect(":")
            yield key

    def elements(self) -> Iterator[None]:
        self._expect("[")
        first = True
        while self._apart("]", first):
            first = False
            yield

    def end(self) -> None:
        if self.peek():
            raise ValueError("extra data")


class Spool:
    """Items put aside in a temporary file of this task and taken back in order."""

    def __init__(self, batch: int = 500):
        self._file, self._batch, self._held = tempfile.TemporaryFile(), batch, []

    def add(self, item: Any) -> None:
        self._held.append(item)
        if len(self._held) >= self._batch:
            self._flush()

    def _flush(self) -> None:
        pickle.dump(self._held, self._file, 5)
        self._held = []

    def __iter__(self) -> Iterator[Any]:
        self._flush()
        self._file.seek(0)
        while True:
            try:
                yield from pickle.load(self._file)
            except EOFError:
                return


def of_layer(layer: Layer, fragment) -> Iterator[tuple[tuple, Any]]:
    """(order of the layer, fragment) of each feature, in walking order."""
    for order, x in layer.layers():
        for f in x.features:
            yield order, fragment(f, len(order))


def planned(rows: Iterable[tuple[list, list, Any]], layer: Layer) -> Iterator[tuple[tuple, Any]]:
    """(order, fragment) of sorted rows (order, path, fragment). Before the first that is below the root, and at the end, ``layer`` has all layers
    and their names: a name may come with a later row, so rows below the root are spooled."""
    spool, seen = None, set()
    for order, path, fragment in rows:
        if spool is None and not order:
            yield (), fragment
            continue
        spool = Spool() if spool is None else spool
        spool.add((tuple(order), fragment))
        if (key := (tuple(order), tuple(path or ()))) not in seen:
            seen.add(key)
            place(layer, order, path)
    if spool is not None:
        yield from spool
