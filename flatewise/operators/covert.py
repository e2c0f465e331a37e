"""The padding channel: message bits in the unused bits of a stream's last byte, and its detection."""

from __future__ import annotations

from flatewise.operators import inflate

SUSPICIOUS_SHARE = 0.30
LEAST_PADDED = 8


def to_bits(data: bytes) -> list[int]:
    return [b >> i & 1 for b in data for i in range(8)]


def to_bytes(bits: list[int]) -> bytes:
    return bytes(sum(bit << i for i, bit in enumerate(bits[k : k + 8])) for k in range(0, len(bits) // 8 * 8, 8))


def embed(raw: bytes, bits: list[int]) -> bytes:
    """Write bits into the padding; what does not fit is left out.  The content stays the same."""
    record = inflate.parse(raw, keep_output=False)
    room = record.pad_bits
    if not room or not bits:
        return raw
    at, used = record.end_bit // 8 - 1, 8 - room
    value = raw[at] & ((1 << used) - 1) | sum(b << (used + i) for i, b in enumerate(bits[:room]))
    return raw[:at] + bytes([value]) + raw[at + 1 :]


def extract(raw: bytes, n: int) -> list[int]:
    record = inflate.parse(raw, keep_output=False)
    return [record.pad_value >> i & 1 for i in range(min(n, record.pad_bits))]


def shares(rooms: list[int], n: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of a message of n bits that each of some paddings takes, in order."""
    out, at = [], 0
    for room in rooms:
        take = min(room, n - at)
        out.append((at, take))
        at += take
    return out


def spread(streams: list[bytes], message: bytes) -> list[bytes]:
    """Lay a message over the paddings of several streams, in order."""
    bits = to_bits(message)
    rooms = [inflate.parse(raw, keep_output=False).pad_bits for raw in streams]
    return [embed(raw, bits[at : at + n]) for raw, (at, n) in zip(streams, shares(rooms, len(bits)))]


def steerer(bits: list[int]):
    """Callback for our own encoder: each match carries a bit, 1 by being one byte shorter where that is legal."""
    left = iter(bits)

    def steer(_position, length, distance):
        return (length - 1 if next(left, 0) and length > inflate.MIN_MATCH else length), distance

    return steer


def score(pads: list[tuple[int, int]]) -> dict:
    """Corpus score from (padding bits, padding value) of streams."""
    padded = sum(n > 0 for n, _ in pads)
    odd = sum(n > 0 and v != 0 for n, v in pads)
    share = odd / padded if padded else 0.0
    return {"streams": len(pads), "with_padding": padded, "nonzero_padding": odd, "share_of_padded": share, "suspicious": share > SUSPICIOUS_SHARE and padded >= LEAST_PADDED}
