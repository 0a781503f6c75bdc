import sys

from tessera.plans import commands, pipeline

raise SystemExit(commands.main(sys.argv[1:]) if sys.argv[1:2] and sys.argv[1] in ("analyse", "aggregate", "sizes") else pipeline.main())
