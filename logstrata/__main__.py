import sys

from logstrata.cli import main

sys.exit(main(sys.argv[1:]))
