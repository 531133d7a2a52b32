"""Node types of graphs; importing this registers them."""

from . import containers, control, remote, scalars, tables  # noqa: F401
