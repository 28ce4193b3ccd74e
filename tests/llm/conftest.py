"""Lets the modules of this folder import one another."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
