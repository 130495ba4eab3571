import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# both conftest files have one module name: tests one folder up may import these from this one
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
