"""SHA-256 in steps: a digest's state as bytes, so that one task can go on where another stopped."""

from __future__ import annotations

import _hashlib
import ctypes

# hashlib's objects can't leave their process; the functions of the OpenSSL that it uses keep their state in plain memory
_LIB = ctypes.CDLL(_hashlib.__file__)
#: Bytes of a state: OpenSSL's SHA256_CTX has 112.
_SIZE = 128


def start() -> bytes:
    state = ctypes.create_string_buffer(_SIZE)
    _LIB.SHA256_Init(state)
    return state.raw


def update(state: bytes, address: int, size: int) -> bytes:
    """The state after `size` more bytes at `address`."""
    held = ctypes.create_string_buffer(state, _SIZE)
    _LIB.SHA256_Update(held, ctypes.c_void_p(address), ctypes.c_size_t(size))
    return held.raw


def finish(state: bytes) -> str:
    out, held = ctypes.create_string_buffer(32), ctypes.create_string_buffer(state, _SIZE)
    _LIB.SHA256_Final(out, held)
    return out.raw.hex()
