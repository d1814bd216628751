import sys

from .plans.serving import main

sys.exit(main(sys.argv[1:]))
