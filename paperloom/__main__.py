import sys

from paperloom.cli import main

sys.exit(main())
