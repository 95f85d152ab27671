"""python -m lodestack"""

import sys

from .plans.workflow import main

sys.exit(main())
