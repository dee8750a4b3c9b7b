from tessera.repl import main

raise SystemExit(main())
