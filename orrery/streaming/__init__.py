"""Streaming frames.

Operations that look at one row at a time (projection, masks, element-wise
kernels, maps, concatenation, joins with a static right side) work unchanged on
a Frame over a streaming DataFrame; what needs an order or all rows does not.
"""

from __future__ import annotations

from orrery.errors import UnsupportedError


def require_static(frame):
    """Refuse a stream where an operation needs every row."""
    if frame.df.isStreaming:
        raise UnsupportedError("this operation needs all rows; the frame is a stream")
    return frame
