from tabeval.functions.values import *  # noqa: F401,F403
