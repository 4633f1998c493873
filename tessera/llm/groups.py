"""The first member of each group, as the whole library finds it."""

from tessera.operators.groups import with_first

__all__ = ["with_first"]
