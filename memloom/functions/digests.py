"""SHA-256 whose state can be handed on: OpenSSL's context is a plain block of bytes."""

from __future__ import annotations

import _hashlib
import ctypes
from functools import cache

#: Bytes of OpenSSL's SHA256_CTX: eight words of state, the bit count, one block of input and two lengths.
STATE_BYTES = 112


@cache
def _library() -> ctypes.CDLL:
    """The OpenSSL that ``hashlib`` itself is linked to."""
    library = ctypes.CDLL(_hashlib.__file__)
    for name, kinds in (("SHA256_Init", [ctypes.c_char_p]), ("SHA256_Update", [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]), ("SHA256_Final", [ctypes.c_char_p, ctypes.c_char_p])):
        getattr(library, name).argtypes = kinds
    return library


def available() -> bool:
    try:
        return bool(_library())
    except (AttributeError, OSError):
        return False


class Sha256:
    """A digest that starts from ``state``, or from nothing."""

    def __init__(self, state: bytes | None = None) -> None:
        self._context = ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            _library().SHA256_Init(self._context)

    def update(self, data: bytes) -> Sha256:
        _library().SHA256_Update(self._context, data, len(data))
        return self

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        copy, digest = ctypes.create_string_buffer(self._context.raw, STATE_BYTES), ctypes.create_string_buffer(32)
        _library().SHA256_Final(digest, copy)
        return digest.raw.hex()
