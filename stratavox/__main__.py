"""``python -m stratavox --map FOLDER``"""

import sys

from stratavox.plans.job import main

sys.exit(main())
