"""Tables written in the shared folder: see ``sessionloom.scratch``."""

from ..scratch import Scratch, shared_dir, swept

__all__ = ["Scratch", "shared_dir", "swept"]
