import os
import sys
from pathlib import Path

HERE = str(Path(__file__).resolve().parent)
sys.path[:0] = [HERE, str(Path(HERE).parent)]
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")
