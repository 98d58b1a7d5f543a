"""Column-expression builders (scalar functions N1–N23, V1)."""

from rosterline.functions.normalize import *  # noqa: F401,F403
from rosterline.functions.vocab import *  # noqa: F401,F403
from rosterline.functions.payload import *  # noqa: F401,F403
from rosterline.functions.merge import *  # noqa: F401,F403
