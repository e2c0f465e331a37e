from flatewise.cli import main

raise SystemExit(main())
