"""Imports every plan module so that their queries register themselves."""

from . import register  # noqa: F401
from . import store  # noqa: F401
from . import quality  # noqa: F401
from . import spatial  # noqa: F401
from . import text  # noqa: F401
from . import logs  # noqa: F401
from . import alerts  # noqa: F401
from . import health  # noqa: F401
from . import requests  # noqa: F401
from . import sources  # noqa: F401
from . import streams  # noqa: F401
from . import clusters  # noqa: F401
