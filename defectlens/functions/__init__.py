from . import geometry, labels, text, vectors  # noqa: F401
from .register import register  # noqa: F401
