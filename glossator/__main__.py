import sys

from glossator.cli import main

sys.exit(main())
