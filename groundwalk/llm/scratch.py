"""Tables cut out of a long plan: the package's own, under a name that the operators share."""

from ..scratch import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]
