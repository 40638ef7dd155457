from .fixtures import none, odd  # noqa: F401
