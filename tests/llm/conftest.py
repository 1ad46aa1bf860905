"""Tests of this folder share helpers by the plain names of their modules."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
