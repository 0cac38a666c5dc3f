from . import text_ops  # noqa: F401
