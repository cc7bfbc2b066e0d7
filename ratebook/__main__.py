import sys

from ratebook.cli import main

sys.exit(main())
