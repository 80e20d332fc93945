import importlib.util
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
_spec = importlib.util.spec_from_file_location("library_conftest", os.path.join(ROOT, "tests", "conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
spark = _module.spark  # the session fixture of the library's tests
